"""Answers of a judge, reactions of readers, corpora by configuration, and how much a split loses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import judgement, reactions
from lodestone.plans.registry import query
from lodestone.sources import corpora, responses

_STATES = "['O','C','L','N']"
_JSON = f"""'{{"verdicts": [{{"party_name": "ALICE", "classification": "' || {_STATES}[event_id % 4 + 1] || '"' || CASE WHEN event_id % 3 = 0 THEN ', "confidence": 0.75, "primary_dimension": "HARM"' ELSE '' END || '}}, {{"party_name": "Bob", "classification": "' || CASE WHEN event_id % 13 = 0 THEN 'X' ELSE 'L' END || '"}}], "advice": "' || event_type || '"}}'"""


@query("AG9", f"""
WITH j AS (SELECT event_id, {_JSON} AS j, event_type, CASE WHEN event_id % 2 = 0 THEN {_STATES}[(event_id // 2) % 4 + 1] END AS expected FROM events),
t AS (SELECT *, event_id % 6 AS kind FROM j), v AS (
  SELECT event_id, kind IN (3, 4) OR event_id % 13 = 0 AS failed, expected, event_type, {_STATES}[event_id % 4 + 1] AS state, event_id % 3 = 0 AS sure FROM t)
SELECT event_id, failed, CASE WHEN failed THEN 0 ELSE 2 END AS verdicts, CASE WHEN failed OR expected IS NULL THEN NULL ELSE state = expected END AS first_correct,
  CASE WHEN failed THEN NULL WHEN sure THEN 0.75::DOUBLE ELSE 0.5 END AS confidence, CASE WHEN failed THEN NULL WHEN sure THEN 'HARM' ELSE 'UNKNOWN' END AS dimension, CASE WHEN failed THEN '' ELSE event_type END AS advice FROM v""")
def parsed_answers(t):
    """Answers inside a fence, with and without the word json, plain ones, ones that are cut off, and none at all; some have a state that doesn't exist."""
    k = F.col("event_id")
    states = F.array(*map(F.lit, "OCLN"))
    sure = F.when(k % 3 == 0, ', "confidence": 0.75, "primary_dimension": "HARM"').otherwise("")
    body = F.concat(
        F.lit('{"verdicts": [{"party_name": "ALICE", "classification": "'), F.get(states, (k % 4).cast("int")), F.lit('"'), sure,
        F.lit('}, {"party_name": "Bob", "classification": "'), F.when(k % 13 == 0, "X").otherwise("L"), F.lit('"}], "advice": "'), F.col("event_type"), F.lit('"}'),
    )
    fence = "```"
    text = F.when(k % 6 == 0, F.concat(F.lit(f"  {fence}json\n"), body, F.lit(f"\n{fence} and more"))).when(k % 6 == 1, F.concat(F.lit(fence), body, F.lit(fence))).when(k % 6 == 3, F.substr(body, F.lit(1), F.char_length(body) - 1)).when(k % 6 != 4, body)
    expected = F.when(k % 2 == 0, F.get(states, (F.floor(k / 2) % 4).cast("int")))
    parties = F.array(F.struct(F.lit("Alice").alias("name"), expected.alias("expected_state")), F.struct(F.lit("bob").alias("name"), F.lit("L").alias("expected_state")))
    rows = t("events").select("event_id", F.explode(F.array(responses.parsed(text, parties))).alias("r"))
    first = F.get("r.verdicts", F.lit(0))
    return rows.select("event_id", "r.failed", F.size("r.verdicts").alias("verdicts"), first["correct"].alias("first_correct"), first["confidence"].alias("confidence"), first["primary_dimension"].alias("dimension"), "r.advice")


_OUTCOMES = {"grateful": ["worked it out", "saw it clearly", "resolved itself"], "neutral": ["mixed", "complicated", "no regret"]}


def _u(salt: str) -> str:
    return f"(('0x' || md5(event_id || ':{salt}')[1:8])::BIGINT / 4294967296::DOUBLE)"


def _text(mood: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in _OUTCOMES[mood]) + f"][(floor({_u('outcome')} * 3) + 1)::INT]"


@query("SPL16", f"""
WITH e AS (SELECT event_id, user_id, {_u('follow-up')} < 0.3 AS asked, event_id % 5 = 0 OR {_STATES}[event_id % 4 + 1] = {_STATES}[user_id % 4 + 1] AS pleased, (200 + floor({_u('comments')} * 1801))::BIGINT AS comments FROM events)
SELECT event_id, CASE WHEN asked THEN CASE WHEN pleased THEN {_text('grateful')} ELSE {_text('neutral')} END END AS outcome, CASE WHEN asked THEN CASE WHEN pleased THEN 'grateful' ELSE 'neutral' END END AS satisfaction,
  comments, (comments // 2 + floor({_u('shares')} * (comments * 3 - comments // 2 + 1)))::BIGINT AS shares, (50 + floor({_u('saves')} * 451))::BIGINT AS saves FROM e""")
def readers_reactions(t):
    k = F.col("event_id")
    states = F.array(*map(F.lit, "OCLN"))
    verdicts = F.array(F.struct(F.get(states, (k % 4).cast("int")).alias("state"), F.when(k % 5 != 0, F.get(states, (F.col("user_id") % 4).cast("int"))).alias("expected")))
    rows = t("events").select("event_id", reactions.follow_up(k, verdicts, _OUTCOMES).alias("f"), reactions.engagement(k).alias("e"))
    return rows.select("event_id", "f.outcome", "f.satisfaction", "e.comments", "e.shares", "e.saves")


#: Three corpora, one of which is switched off.
_CONFIG = {
    "corpora": {
        "documents": {"enabled": True, "table": "documents", "id": "doc_id", "text": "text", "category": "lang", "periods": {"en": "MODERN", "de": "CLASSICAL"}},
        "items": {"enabled": False, "table": "benchmark", "id": "item_id", "text": "text"},
        "turns": {"enabled": True, "table": "conversations", "id": "conv_id", "text": "text", "max_samples": 100},
    }
}


@query("SRC21 SET1 PRJ11", """
SELECT 'documents' AS corpus, CASE lang WHEN 'en' THEN 'MODERN' WHEN 'de' THEN 'CLASSICAL' ELSE 'UNKNOWN' END AS period, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL
UNION ALL SELECT 'turns', 'UNKNOWN', count(*), NULL FROM (SELECT 1 FROM conversations LIMIT 100)""")
def configured_corpora(t):
    by = corpora.union(_CONFIG, t).groupBy("corpus", "period").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    # Which of a conversation's turns are kept is open where their ids are equal.
    return by.withColumn("chars", F.when(F.col("corpus") == "documents", F.col("chars")))


@query("ST24 AG22", """
WITH p AS (SELECT lang, quality AS t, length(text) % 2 AS p FROM documents JOIN labels USING (doc_id)), u AS (SELECT lang, t, p FROM p UNION ALL SELECT 'all', t, p FROM p),
c AS (SELECT lang, c, count(*) FILTER (WHERE t = c AND p = c) AS tp, count(*) FILTER (WHERE t <> c AND p = c) AS fp, count(*) FILTER (WHERE t = c AND p <> c) AS fn FROM u, (VALUES (0), (1)) AS k(c) GROUP BY ALL),
f AS (SELECT lang, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS f1 FROM c GROUP BY lang)
SELECT f.lang, round(b.f1 - f.f1, 9) AS degradation, round((b.f1 - f.f1) / b.f1, 9) AS relative FROM f, (SELECT f1 FROM f WHERE lang = 'all') b WHERE f.lang <> 'all'""")
def degradation(t):
    """How much lower macro F1 is in one language than over all."""
    rows = t("documents").join(t("labels"), "doc_id").select("lang", F.col("quality").alias("t"), (F.char_length("text") % 2).cast("int").alias("p"))
    own = judgement.macro_f1(rows, "t", "p", ["lang"]).select("lang", F.col("macro_f1").alias("f1"))
    base = judgement.macro_f1(rows, "t", "p").select(F.col("macro_f1").alias("base"))
    gap = F.col("base") - F.col("f1")
    return own.join(F.broadcast(base), F.lit(True)).select("lang", F.round(gap, 9).alias("degradation"), F.round(gap / F.nullif(F.col("base"), F.lit(0.0)), 9).alias("relative"))
