"""Metrics of verdicts over the events table (see streaming.windows.judged) and of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dihedral
from lodestone.operators import judgement
from lodestone.plans.registry import query
from lodestone.streaming.windows import judged

_V = """v AS (SELECT user_id AS session, event_id AS "case", event_type AS protocol, ts, ['O','C','L','N'][floor(value)::INT % 4 + 1] AS state,
  CASE WHEN (props->>'$.k')::INT % 5 <> 0 THEN ['O','C','L','N'][(props->>'$.k')::INT % 4 + 1] END AS expected FROM events)"""
_MISS = "sum(CASE WHEN expected IS NOT NULL AND state <> expected THEN 1 ELSE 0 END)"


@query("AG9", f"WITH {_V} SELECT session, protocol, count(*) AS n, {_MISS}::BIGINT AS defects, round({_MISS} / count(*) / 2.0, 9) AS bond_index FROM v GROUP BY session, protocol")
def bond_index(t):
    out = judgement.bond_index(judged(t("events")), ["session", "protocol"], tau=2.0)
    return out.withColumn("bond_index", F.round("bond_index", 9))


@query("AG8", f"""
WITH {_V} SELECT session, count(DISTINCT "case") AS trials, count(*) FILTER (WHERE state = expected) AS correct,
  round(count(*) FILTER (WHERE state = expected) / count(DISTINCT "case"), 9) AS accuracy_per_trial, round(count(*) FILTER (WHERE state = expected) / nullif(count(expected), 0), 9) AS accuracy_per_verdict FROM v GROUP BY session""")
def session_accuracy(t):
    out = judgement.accuracy(judged(t("events")), ["session"], "case")
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy_per_trial", "accuracy_per_verdict")})


_PAIRS = f"""{_V}, r AS (SELECT session, "case", state FROM v), p AS (SELECT a.state AS c1, b.state AS c2 FROM r a JOIN r b ON a.session = b.session AND a."case" < b."case")"""


@query("AG10 JN9", f"""
WITH {_PAIRS}, s AS (SELECT count(*) FILTER (WHERE c1 IN ('O','C')) AS o_c_pairs, count(*) FILTER (WHERE (c1 = 'O' AND c2 <> 'C') OR (c1 = 'C' AND c2 <> 'O')) AS o_c_violations,
  count(*) FILTER (WHERE c1 IN ('L','N')) AS l_n_pairs, count(*) FILTER (WHERE (c1 = 'L' AND c2 <> 'N') OR (c1 = 'N' AND c2 <> 'L')) AS l_n_violations FROM p)
SELECT *, round(1 - o_c_violations / o_c_pairs, 9) AS o_c_rate, round(1 - l_n_violations / l_n_pairs, 9) AS l_n_rate, round((o_c_violations + l_n_violations) / (o_c_pairs + l_n_pairs), 9) AS bond_index FROM s""")
def correlative_symmetry(t):
    out = judgement.correlative_symmetry(judgement.correlative_pairs(judged(t("events")), "session", "case"))
    return out.withColumns({c: F.round(c, 9) for c in ("o_c_rate", "l_n_rate", "bond_index")})


@query("AG11", f"""
WITH {_V}, g AS (SELECT protocol || '_' || session % 10 AS gate, coalesce(expected, 'O') AS f, state AS t, "case" AS o FROM v),
n AS (SELECT gate, count(*) AS n FROM g GROUP BY gate HAVING count(*) >= 2),
mf AS (SELECT gate, f FROM (SELECT gate, f, count(*) AS c, min(o) AS m FROM g GROUP BY gate, f) QUALIFY row_number() OVER (PARTITION BY gate ORDER BY c DESC, m) = 1),
mt AS (SELECT gate, t FROM (SELECT gate, t, count(*) AS c, min(o) AS m FROM g GROUP BY gate, t) QUALIFY row_number() OVER (PARTITION BY gate ORDER BY c DESC, m) = 1)
SELECT g.gate, n.n, mf.f AS modal_from, mt.t AS modal_to, round(avg((g.f = mf.f AND g.t = mt.t)::INT::DOUBLE), 9) AS effectiveness
FROM g JOIN n ON g.gate = n.gate JOIN mf ON g.gate = mf.gate JOIN mt ON g.gate = mt.gate WHERE mf.f <> mt.t GROUP BY ALL""")
def gate_effectiveness(t):
    v = judged(t("events"))
    rows = v.select(F.concat("protocol", F.lit("_"), F.col("session") % 10).alias("gate"), F.coalesce("expected", F.lit("O")).alias("from"), F.col("state").alias("to"), F.col("case").alias("ordinal"))
    return judgement.gate_effectiveness(rows).withColumn("effectiveness", F.round("effectiveness", 9))


@query("AG12 EXP9", """
WITH m AS (SELECT event_type AS context, 'd' || user_id % 4 AS dimension, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT context, dimension, round(mean, 6) AS mean, round(mean / sum(mean) OVER (PARTITION BY context), 6) AS weight FROM m""")
def dimension_weights(t):
    rows = t("events").select(F.col("event_type").alias("context"), F.concat(F.lit("d"), F.col("user_id") % 4).alias("dimension"), "value")
    return judgement.dimension_weights(rows, ["context"]).withColumns({c: F.round(c, 6) for c in ("mean", "weight")})


@query("AG13", f"""
WITH {_V}, c AS (SELECT session, protocol, state, count(*) AS v FROM v GROUP BY ALL), s AS (SELECT session, protocol, sum(v)::BIGINT AS votes, max(v) AS top FROM c GROUP BY ALL HAVING sum(v) >= 2)
SELECT session, protocol, votes, round(top / votes, 9) AS agreement, CASE WHEN top / votes >= 0.85 THEN 'high' WHEN top / votes < 0.6 THEN 'contested' ELSE 'mixed' END AS level FROM s""")
def agreement(t):
    return judgement.agreement(judged(t("events")), ["session", "protocol"]).withColumn("agreement", F.round("agreement", 9))


@query("AG21", """
WITH p AS (SELECT quality AS truth, (length(text) % 3 > 0)::INT AS predicted FROM documents JOIN labels USING (doc_id))
SELECT truth, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 9) AS share FROM p GROUP BY truth, predicted""")
def confusion(t):
    rows = t("documents").join(t("labels"), "doc_id").select("quality", (F.char_length("text") % 3 > 0).cast("int").alias("p"))
    return judgement.confusion(rows, "quality", "p").withColumn("share", F.round("share", 9))


@query("AG22", """
WITH p AS (SELECT lang, quality AS t, (length(text) % 3)::INT AS p FROM documents JOIN labels USING (doc_id)), l AS (SELECT DISTINCT lang, t AS label FROM p UNION SELECT DISTINCT lang, p FROM p),
f AS (SELECT l.lang, label, count(*) FILTER (WHERE t = label AND p = label) AS tp, count(*) FILTER (WHERE t <> label AND p = label) AS fp, count(*) FILTER (WHERE t = label AND p <> label) AS fn FROM l JOIN p ON l.lang = p.lang GROUP BY l.lang, label)
SELECT f.lang, (SELECT count(*) FROM p WHERE p.lang = f.lang) AS n, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1, round(sum(tp) / (SELECT count(*) FROM p WHERE p.lang = f.lang), 9) AS accuracy FROM f GROUP BY f.lang""")
def macro_f1(t):
    rows = t("documents").join(t("labels"), "doc_id").select("lang", F.col("quality").alias("t"), (F.char_length("text") % 3).cast("int").alias("p"))
    return judgement.macro_f1(rows, "t", "p", ["lang"]).withColumns({c: F.round(c, 9) for c in ("macro_f1", "accuracy")})


_ELEMENTS = "['e','r','r2','r3','s','sr','sr2','sr3']"


@query("ST20", f"""
WITH x AS (SELECT (props->>'$.k')::INT % 8 AS ia, event_id % 8 AS ib FROM events), y AS (SELECT ia, ib, ia // 4 AS ma, ia % 4 AS ka, ib // 4 AS mb, ib % 4 AS kb FROM x)
SELECT {_ELEMENTS}[ia + 1] AS a, {_ELEMENTS}[ib + 1] AS b, {_ELEMENTS}[((ma + mb) % 2) * 4 + ((CASE WHEN mb = 1 THEN kb - ka ELSE ka + kb END) + 8) % 4 + 1] AS product, count(*) AS n FROM y GROUP BY ALL""")
def dihedral_products(t):
    """Products of two elements that each event gives, and how often."""
    of = lambda c: F.get(F.array(*map(F.lit, dihedral.ELEMENTS)), F.pmod(c, F.lit(8)).cast("int"))
    rows = t("events").select(of(F.get_json_object("props", "$.k").cast("int")).alias("a"), of(F.col("event_id")).alias("b"))
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", dihedral.multiply(F.col("a"), F.col("b")).alias("product"), "n")


@query("ST20", f"""
WITH {_V} SELECT "case", CASE state WHEN 'O' THEN 'C' WHEN 'C' THEN 'O' WHEN 'L' THEN 'N' ELSE 'L' END AS correlative, CASE state WHEN 'O' THEN 'C' WHEN 'C' THEN 'L' WHEN 'L' THEN 'N' ELSE 'O' END AS turned FROM v""")
def state_actions(t):
    s = F.col("state")
    return judged(t("events")).select("case", dihedral.correlative(s).alias("correlative"), dihedral.act(dihedral.compose(F.array(F.lit("s"), F.lit("s"), F.lit("r"))), s).alias("turned"))


@query("ST24", f"""
WITH {_V}, s AS (SELECT protocol, count(*) FILTER (WHERE state = expected) / count(expected) AS f1, {_MISS} / count(*) AS leak FROM v GROUP BY protocol)
SELECT protocol, round(f1, 9) AS f1, round(leak, 9) AS leak, CASE WHEN f1 > 0.25 AND leak < 0.6 THEN 'SUCCESS' WHEN f1 > 0.25 THEN 'LEAK' WHEN leak < 0.6 THEN 'WEAK' ELSE 'FAIL' END AS verdict, round(f1 / nullif(leak, 0), 9) AS retention FROM s""")
def split_verdicts(t):
    v = judged(t("events"))
    s = v.groupBy("protocol").agg((F.count_if(F.col("state") == F.col("expected")) / F.count("expected")).alias("f1"), (F.sum(F.when(F.col("expected").isNotNull() & (F.col("state") != F.col("expected")), 1).otherwise(0)) / F.count(F.lit(1))).alias("leak"))
    good, tight = F.col("f1") > 0.25, F.col("leak") < 0.6
    word = F.when(good & tight, "SUCCESS").when(good, "LEAK").when(tight, "WEAK").otherwise("FAIL")
    return s.select("protocol", F.round("f1", 9).alias("f1"), F.round("leak", 9).alias("leak"), word.alias("verdict"), F.round(F.col("f1") / F.nullif("leak", F.lit(0.0)), 9).alias("retention"))


@query("stream: windows", f"""
WITH {_V} SELECT date_trunc('hour', ts) AS start, protocol, count(*) AS n, {_MISS}::BIGINT AS defects FROM v GROUP BY ALL""")
def hourly_index(t):
    from lodestone.streaming.windows import windowed_index

    return windowed_index(judged(t("events"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "protocol", "n", "defects")
