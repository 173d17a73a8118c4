"""Queries of the rule engine, with the sample lexicon (words that the synthetic tables hold) and with the shipped ones."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import rules as R
from lodestone.plans.registry import query

#: Words of a text in SQL: runs of letters, digits and "_", in lower case. Single words match there as \\b does.
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in vs)}))) AS {c.lower()}" for c, vs in L.SAMPLE_CLASSES.items())
_COUNTED = f"SELECT doc_id, lang, {_COUNTS} FROM (SELECT doc_id, lang, {_TOKENS} AS w FROM documents)"
_ITEMS = "[" + ", ".join(f"{{'m': -{c.lower()}, 'o': {i}, 'c': '{c}'}}" for i, c in enumerate(L.SAMPLE_CLASSES)) + "]"
_TOP = f"list_sort(list_filter({_ITEMS}, lambda x: x.m < 0))"
_FIRST = "CASE " + " ".join(f"WHEN {c.lower()} > 0 THEN '{c}'" for c in L.SAMPLE_CLASSES) + " END"


@query("RUL2 RUL3 AG1 AG6 PRJ5", f"""
WITH c AS ({_COUNTED}), d AS (SELECT lang, coalesce({_TOP}[1].c, 'NONE') AS class FROM c)
SELECT lang, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 9) AS share FROM d GROUP BY lang, class""")
def rule_distribution(t):
    from pyspark.sql import Window as W

    d = t("documents").select("lang", F.coalesce(R.top_class(F.col("text"), L.SAMPLE_LEXICON), F.lit("NONE")).alias("class"))
    n = d.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 9))


@query("RUL2", f"WITH c AS ({_COUNTED}) SELECT doc_id, array_to_string(list_transform({_TOP}, lambda x: x.c || ':' || -x.m), ' ') AS ranked FROM c")
def relation_counts(t):
    found = R.class_counts(F.col("text"), L.SAMPLE_LEXICON)
    return t("documents").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat(x["class"], F.lit(":"), x["n"])), " ").alias("ranked"))


@query("RUL8 RUL13 RUL25 FLT6 AG7", f"""
WITH c AS ({_COUNTED}), d AS (SELECT lang, {_FIRST} AS bond FROM c)
SELECT lang, round(avg((bond IS NOT NULL)::INT::DOUBLE), 9) AS coverage, count(bond) AS labelled FROM d GROUP BY lang""")
def rule_coverage(t):
    d = t("documents").select("lang", R.first_class(F.col("text"), L.SAMPLE_LEXICON).alias("bond"))
    return d.groupBy("lang").agg(F.round(F.avg(F.col("bond").isNotNull().cast("double")), 9).alias("coverage"), F.count("bond").alias("labelled"))


@query("RUL13 RUL14 AG2 AG3", f"""
WITH c AS ({_COUNTED}), d AS (SELECT lang, unnest(list_filter([{', '.join(f"CASE WHEN {c.lower()} > 0 THEN '{c}' END" for c in L.SAMPLE_CLASSES)}], lambda x: x IS NOT NULL)) AS class FROM c)
SELECT lang, class, count(*) AS n FROM d GROUP BY lang, class""")
def pattern_counts(t):
    hits = t("documents").select("lang", F.explode(R.pattern_hits(F.col("text"), L.SAMPLE_LEXICON)).alias("h"))
    return hits.groupBy("lang", F.col("h.class").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _or(words):
    return " OR ".join(f"contains(text, '{w}')" for w in words)


_MODAL = {"obligation": ["therha", "erth"], "permission": ["edan", "onre"], "prohibition": ["ha the"], "supererogation": ["inan"]}
_CUES = ["not", "onst"]


@query("RUL9 RUL10 RUL11", f"""
WITH m AS (SELECT doc_id, text, CASE {' '.join(f"WHEN {_or(ws)} THEN '{c}'" for c, ws in _MODAL.items())} ELSE 'unknown' END AS class FROM documents)
SELECT doc_id, {_or(_CUES)} AS negated, CASE {' '.join(f"WHEN contains(text, '{w}') THEN '{w}'" for ws in _MODAL.values() for w in ws)} END AS modal,
  CASE class WHEN 'obligation' THEN 'OBLIGATION' WHEN 'permission' THEN 'LIBERTY' WHEN 'prohibition' THEN 'NO_RIGHT' WHEN 'supererogation' THEN 'LIBERTY' ELSE 'OBLIGATION' END AS state,
  CASE WHEN class IN ('obligation', 'prohibition') THEN 'prescriptive' WHEN class = 'permission' THEN 'descriptive' ELSE 'unknown' END AS context
FROM m""")
def modal_states(t):
    b = R.bond(F.col("text"), L.SAMPLE_LEXICON, _MODAL, _CUES)
    return t("documents").select("doc_id", b["negated"].alias("negated"), b["modal"].alias("modal"), b["state"].alias("state"), b["context"].alias("context"))


@query("RUL7 RUL22", f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents), f AS (SELECT doc_id, list_contains(w, 'idiot') OR list_contains(w, 'clown') OR list_contains(w, 'with') AS d, list_contains(w, 'you') AS u FROM w)
SELECT doc_id, CASE WHEN d AND NOT u THEN 'contested' WHEN u THEN 'universal' ELSE 'high' END AS tier, d AND NOT u AS has_dispute FROM f""")
def consensus_tiers(t):
    c = R.consensus(F.col("text"), [r"\bidiot\b", r"\bclown\b", r"\bwith\b"], [r"\byou\b"])
    return t("documents").select("doc_id", c["tier"].alias("tier"), c["has_dispute"].alias("has_dispute"))


@query("RUL1", f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
r AS (SELECT doc_id, w, list_sort(list_filter([CASE WHEN list_has_any(w, ['the','this']) THEN 'SELF' END, CASE WHEN list_has_any(w, ['of']) THEN 'OTHER' END, CASE WHEN list_has_any(w, ['and']) THEN 'FAMILY' END], lambda x: x IS NOT NULL)) AS roles FROM w)
SELECT doc_id, array_to_string(CASE WHEN len(roles) > 0 THEN roles ELSE ['OTHER', 'SELF'] END, ',') AS roles FROM r""")
def role_presence(t):
    found = R.roles(F.col("text"), {"SELF": [r"\b(the|this)\b"], "OTHER": [r"\bof\b"], "FAMILY": [r"\band\b"]})
    return t("documents").select("doc_id", F.array_join(found, ",").alias("roles"))


_GATES = [("binding", r"\bthe\b", "g_the", 0.9, "en"), ("release", r"\bof\b", "g_of", 0.95, "en"), ("nullifier", r"\byou\b", "g_you", 0.5, None)]


@query("RUL21 RUL23", f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents), g AS (SELECT doc_id, list_contains(w, 'the') AS a, list_contains(w, 'of') AS b, list_contains(w, 'you') AS c FROM w)
SELECT doc_id, a::INT + b::INT + c::INT AS gates, CASE WHEN b THEN 'L' WHEN a THEN 'O' END AS state,
  round(CASE WHEN b THEN 0.76::DOUBLE WHEN a THEN 0.72 END, 9) AS confidence FROM g""")
def gate_states(t):
    rows = t("documents").select("doc_id", R.gates(F.col("text"), _GATES).alias("g"))
    state = R.gate_state(F.col("g"))
    return rows.select("doc_id", F.size("g").alias("gates"), state["state"].alias("state"), F.round(state["confidence"], 9).alias("confidence"))


@query("RUL17 RUL19", """
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
SELECT item_id, list_filter(w, lambda x: ends_with(x, 'er'))[1] AS agent, list_filter(w, lambda x: ends_with(x, 'on'))[1] AS patient,
  CASE WHEN len(list_filter(w, lambda x: x = 'the')) > 0 THEN 'regex' ELSE CASE WHEN len(list_filter(w, lambda x: ends_with(x, 'er'))) > 0 THEN 'regex+suffix_fallback' ELSE 'regex+suffix' END END AS method
FROM w""")
def suffix_roles(t):
    roles = R.suffix_roles(F.col("text"), "er", "on")
    first = F.when(F.array_contains(F.split("text", " "), "the"), "CARE")
    second = F.when(roles["agent"].isNotNull(), F.lit("DUTY"))
    return t("benchmark").select("item_id", roles["agent"].alias("agent"), roles["patient"].alias("patient"), R.with_fallback([("regex", first), ("suffix", second)])["method"].alias("method"))


@query("RUL24 ST24", r"""
WITH m AS (SELECT item_id, text, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE WHEN lower(x) IN ('the', 'this') THEN '[MASK]' ELSE x END), '') AS masked FROM benchmark)
SELECT item_id, md5(masked) AS text_md5, round((len(string_split(text, ' ')) - len(string_split(masked, '[MASK]')) + 1) / len(string_split(text, ' ')), 9) AS retention FROM m""")
def masked_texts(t):
    text = R.masked(F.col("text"), {"HARM": L.SAMPLE_LEXICON["HARM"]})
    words = F.size(F.split("text", " "))
    return t("benchmark").select("item_id", F.md5(text).alias("text_md5"), F.round((words - F.regexp_count(text, F.lit(r"\[MASK\]"))) / words, 9).alias("retention"))


#: Words of the tables that words of the topics and states take the place of.
_LETTER_WORDS = [(" the ", " mother "), (" of ", " must "), (" and ", " wife "), (" in ", " entitled "), (" to ", " job ")]


def _letters_sql() -> str:
    text = "text"
    for old, new in _LETTER_WORDS:
        text = f"replace({text}, '{old}', '{new}')"
    words = lambda ps: "[" + ", ".join(f"'{w.lower()}'" for p in ps for w in re.findall(r"[A-Za-z]+(?: [A-Za-z]+)*", p.replace("\\b", ""))) + "]"
    topics = " ".join(f"WHEN list_has_any(w, {words(ps)}) THEN '{c}'" for c, ps in L.TOPICS.items())
    single = {c: [w for p in ps for w in re.findall(r"[A-Za-z]+(?: [A-Za-z]+)*", p.replace("\\b", ""))] for c, ps in L.STATES.items()}
    counts = ", ".join(f"{{'m': -({' + '.join(f'len(regexp_extract_all(d, {chr(39)}[^a-z]{w.lower().replace(chr(32), chr(32) * 2)}[^a-z]{chr(39)}))' for w in ws)}), 'o': {i}, 'c': '{c}'}}" for i, (c, ws) in enumerate(single.items()))
    return f"""
WITH x AS (SELECT conv_id, turn, lower({text}) AS x FROM conversations), y AS (SELECT conv_id, turn, {_TOKENS.replace("lower(text)", "x")} AS w, '  ' || regexp_replace(x, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || '  ' AS d FROM x)
SELECT conv_id, turn, CASE {topics} ELSE 'general' END AS topic, list_sort(list_filter([{counts}], lambda x: x.m < 0))[1].c AS state FROM y"""


@query("PRJ13 PRJ14 RUL3", _letters_sql())
def letter_topics(t):
    c = F.col("text")
    for old, new in _LETTER_WORDS:
        c = F.replace(c, F.lit(old), F.lit(new))
    rows = t("conversations").select("conv_id", "turn", F.explode(F.array(c)).alias("text"))
    c = F.col("text")
    return rows.select("conv_id", "turn", R.first_class(F.lower(c), L.TOPICS, "general").alias("topic"), R.top_class(c, L.STATES).alias("state"))
