"""Directions of transfer, lookups, defaults and verdicts. """

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import rules as R
from lodestone.functions import vectors as V
from lodestone.operators import judgement, splits
from lodestone.operators import statistics as S
from lodestone.plans.registry import query
from lodestone.plans.vector_queries import normal_upper_sql
from lodestone.sources import readers
from lodestone.streaming.windows import judged

_KEY = "md5('42:' || doc_id)"
_V = """v AS (SELECT user_id AS session, event_type AS protocol, ['O','C','L','N'][floor(value)::INT % 4 + 1] AS state,
  CASE WHEN (props->>'$.k')::INT % 5 <> 0 THEN ['O','C','L','N'][(props->>'$.k')::INT % 4 + 1] END AS expected FROM events)"""


def _values(t, rows: list[tuple], schema: str):
    return readers.inline(t.spark, rows, schema)


def _sql_values(rows: list[tuple]) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


@query("SPL3", f"""
WITH r AS (SELECT doc_id AS id, lang = 'en' AS f, row_number() OVER (PARTITION BY lang = 'en' ORDER BY {_KEY}) AS k, count(*) OVER (PARTITION BY lang = 'en') AS n FROM documents)
SELECT 'en_to_rest' AS split, CASE WHEN NOT f THEN 'test' WHEN k <= floor(n * 0.9) THEN 'train' ELSE 'valid' END AS role, id FROM r
UNION ALL SELECT 'rest_to_en', CASE WHEN f THEN 'test' WHEN k <= floor(n * 0.9) THEN 'train' ELSE 'valid' END, id FROM r""")
def cross_corpus_splits(t):
    return splits.both_directions(t("documents"), F.col("lang") == "en", ("en", "rest"), "doc_id")


@query("SPL4 JN8", """
WITH p AS (SELECT a.o_orderkey || '-' || b.o_orderkey AS id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate),
r AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id)) AS k, count(*) OVER () AS n FROM p)
SELECT id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS role FROM r""")
def isomorphic_pairs(t):
    pairs = splits.cross_pairs(t("orders"), "o_custkey", "o_orderdate", "o_orderkey").select(F.concat_ws("-", "id_old", "id_new").alias("id"))
    return splits.by_shares(pairs, [("train", 0.7), ("valid", 0.15), ("test", 0.15)], "id")


@query("SPL8", f"""
WITH r AS (SELECT doc_id AS id, lang = 'en' AS f, row_number() OVER (PARTITION BY lang = 'en' ORDER BY {_KEY}) AS k FROM documents),
k AS (SELECT id, f FROM r WHERE k <= (SELECT least(count(*) FILTER (WHERE f), count(*) FILTER (WHERE NOT f)) FROM r))
SELECT 'en_to_rest' AS split, CASE WHEN f THEN 'train' ELSE 'test' END AS role, id FROM k UNION ALL SELECT 'rest_to_en', CASE WHEN f THEN 'test' ELSE 'train' END, id FROM k""")
def balanced_directions(t):
    return splits.balanced_directions(t("documents"), F.col("lang") == "en", ("en", "rest"), "doc_id")


@query("SPL9", f"""
WITH r AS (SELECT doc_id AS id, lang IN ('en', 'de') AS f, row_number() OVER (PARTITION BY lang IN ('en', 'de') ORDER BY {_KEY}) AS k, count(*) OVER (PARTITION BY lang IN ('en', 'de')) AS n FROM documents)
SELECT CASE WHEN NOT f THEN 'test' WHEN k <= least(5000, n // 10) THEN 'valid' ELSE 'train' END AS role, id FROM r""")
def family_split(t):
    return splits.family_split(t("documents"), "lang", ["en", "de"], "doc_id")


@query("SPL10", """
WITH c AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 40) SELECT a.source AS train, b.source AS test FROM c a JOIN c b ON a.source <> b.source""")
def tradition_pairs(t):
    return splits.value_pairs(t("documents"), "source", 40)


@query("SPL14", f"""
SELECT doc_id, CASE WHEN h < '80000000' THEN 'warm' WHEN h < 'cccccccc' THEN 'neutral' ELSE 'cold' END AS tone FROM (SELECT doc_id, substr({_KEY}, 1, 8) AS h FROM documents)""")
def tones(t):
    return t("documents").select("doc_id", splits.weighted_choice(splits.order_key(F.col("doc_id")), [("warm", 0.5), ("neutral", 0.3), ("cold", 0.2)]).alias("tone"))


@query("PRJ9", "SELECT doc_id, 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) AS running FROM documents")
def running_ids(t):
    """Counters over an explicit order: ranks from ranges of the order, so no task numbers the whole table. Ids are unique here; equal ones would get equal counters."""
    counted = S.running_total(t("documents").select("doc_id"), "doc_id", F.lit(1), "n")
    return counted.select("doc_id", F.concat(F.lit("doc_"), F.col("n").cast("bigint").cast("string")).alias("running"))


_CATEGORIES = [("en", "PROMISE", "OBLIGATION"), ("de", "CARE", "LIBERTY"), ("fr", "HARM", "OBLIGATION")]


@query("PRJ21", f"""
WITH m(category, bond, state) AS ({_sql_values(_CATEGORIES)})
SELECT doc_id, coalesce(bond, 'NONE') AS bond, CASE WHEN state = 'OBLIGATION' AND quality = 0 THEN 'PROHIBITION' ELSE coalesce(state, 'LIBERTY') END AS state
FROM documents JOIN labels USING (doc_id) LEFT JOIN m ON lang = category""")
def category_pairs(t):
    m = F.broadcast(_values(t, _CATEGORIES, "category string, bond string, state string"))  # a table of the code, three rows
    rows = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").join(m, F.col("lang") == F.col("category"), "left")
    state = F.when((F.col("state") == "OBLIGATION") & (F.col("quality") == 0), "PROHIBITION").otherwise(F.coalesce("state", F.lit("LIBERTY")))
    return rows.select("doc_id", F.coalesce("bond", F.lit("NONE")).alias("bond"), state.alias("state"))


@query("FLT9", """
WITH s AS (SELECT vec_id, abs(embedding[1]::DOUBLE) / (abs(embedding[1]::DOUBLE) + abs(embedding[2]::DOUBLE) + 1e-9) AS c FROM embeddings) SELECT vec_id, round(c, 6) AS confidence FROM s WHERE c > 0.7""")
def confident_rows(t):
    a, b = F.abs(F.get("embedding", F.lit(0)).cast("double")), F.abs(F.get("embedding", F.lit(1)).cast("double"))
    return t("embeddings").select("vec_id", (a / (a + b + 1e-9)).alias("c")).where("c > 0.7").select("vec_id", F.round("c", 6).alias("confidence"))


@query("FLT11", f"WITH {_V} SELECT session, count(*) AS n FROM v WHERE protocol IN ('click', 'purchase') GROUP BY session")
def protocol_filter(t):
    return judged(t("events")).where(F.col("protocol").isin("click", "purchase")).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("FLT12", """
SELECT source, count(*) FILTER (WHERE lang IN ('en', 'fr')) AS inside, count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) AS outside,
  count(*) FILTER (WHERE lang = 'en' AND n_chars % 3 IN (0, 2)) AS both, count(*) FILTER (WHERE list_has_any([lang, source], ['src1', 'de'])) AS overlap FROM documents GROUP BY source""")
def set_filters(t):
    inside = F.col("lang").isin("en", "fr")
    both = (F.col("lang") == "en") & (F.col("n_chars") % 3).isin(0, 2)
    overlap = F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("src1"), F.lit("de")))
    return t("documents").groupBy("source").agg(*[F.count_if(c).alias(n) for n, c in (("inside", inside), ("outside", ~inside), ("both", both), ("overlap", overlap))])


@query("FLT7", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def prescriptive_only(t):
    return t("documents").select("doc_id", "lang").join(t("labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")


@query("JN6", """
SELECT doc_id, quality AS mark, 'old' AS origin FROM labels UNION ALL SELECT doc_id, -1, 'new' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def merged_when_absent(t):
    old = t("labels").select("doc_id", F.col("quality").alias("mark"), F.lit("old").alias("origin"))
    new = t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("mark"), F.lit("new").alias("origin"))
    return old.unionByName(new)


@query("AG14", f"""
WITH {_V}, c AS (SELECT session, protocol, state, count(*) AS v FROM v GROUP BY ALL), s AS (SELECT session, protocol, max(v) / sum(v) AS a FROM c GROUP BY ALL HAVING sum(v) >= 2)
SELECT count(*) FILTER (WHERE a >= 0.85) AS high, round(coalesce(avg(a) FILTER (WHERE a >= 0.85), 0), 9) AS mean_agreement, round(coalesce(avg(a) FILTER (WHERE a > 1), 0), 9) AS mean_of_none FROM s""")
def mean_agreement(t):
    a = judgement.agreement(judged(t("events")), ["session", "protocol"])
    high = F.col("level") == "high"
    return a.agg(F.count_if(high).alias("high"), F.round(F.coalesce(F.avg(F.when(high, F.col("agreement"))), F.lit(0.0)), 9).alias("mean_agreement"), F.round(F.coalesce(F.avg(F.when(F.col("agreement") > 1, F.col("agreement"))), F.lit(0.0)), 9).alias("mean_of_none"))


@query("AG23", """
SELECT quality AS label, count(*) AS n, round(avg((length(text) % 3 > 0)::INT = quality), 9) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY quality""".replace("round(avg((length(text) % 3 > 0)::INT = quality), 9)", "round(avg(((length(text) % 3 > 0)::INT = quality)::INT::DOUBLE), 9)"))
def class_accuracy(t):
    rows = t("documents").join(t("labels"), "doc_id").select("quality", (F.char_length("text") % 3 > 0).cast("int").alias("p"))
    return rows.groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") == F.col("quality")).cast("double")), 9).alias("accuracy"))


@query("AG24", "SELECT lang, count(DISTINCT source) AS classes, round(1.0 / count(DISTINCT source), 9)::DOUBLE AS chance FROM documents GROUP BY lang")
def chance_level(t):
    n = t("documents").groupBy("lang").agg(F.count_distinct("source").alias("classes"))
    return n.select("lang", "classes", F.round(1 / F.col("classes"), 9).alias("chance"))


@query("AG27", f"""
WITH {_V}, c AS (SELECT protocol, coalesce(expected, 'NONE') AS k, count(*) AS n FROM v GROUP BY ALL)
SELECT protocol, max(n) / sum(n) > 0.21 AS dominated, coalesce(sum(n) FILTER (WHERE k = 'NONE'), 0) / sum(n) > 0.2 AS mostly_none FROM c GROUP BY protocol""")
def dominance(t):
    c = judged(t("events")).groupBy("protocol", F.coalesce("expected", F.lit("NONE")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    none = F.coalesce(F.sum(F.when(F.col("k") == "NONE", F.col("n"))), F.lit(0))
    return c.groupBy("protocol").agg((F.max("n") / F.sum("n") > 0.21).alias("dominated"), (none / F.sum("n") > 0.2).alias("mostly_none"))


@query("ST13", f"""
WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1)::DOUBLE AS k1, count(*) FILTER (WHERE toxic = 1)::DOUBLE AS k2, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang),
g AS (SELECT lang, (k1 / n - k2 / n) / sqrt((k1 + k2) / (n + n) * (1 - (k1 + k2) / (n + n)) * (1 / n + 1 / n)) AS z FROM c)
SELECT lang, round(z, 6) AS z, round(2 * {normal_upper_sql("abs(z)")}, 6) AS p FROM g""")
def proportion_gaps(t):
    c = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(*[x.cast("double").alias(n) for n, x in (("k1", F.count_if(F.col("quality") == 1)), ("k2", F.count_if(F.col("toxic") == 1)), ("n", F.count(F.lit(1))))])
    z, p = S.two_proportions(F.col("k1"), F.col("n"), F.col("k2"), F.col("n"))
    return c.select("lang", F.round(z, 6).alias("z"), F.round(p, 6).alias("p"))


_C = """l AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, list(a ORDER BY d) AS v FROM (SELECT label, d, avg(x) AS a FROM l GROUP BY label, d) GROUP BY label)"""
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"({_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}) + 1e-9))"


@query("ST17", f"""
WITH {_C}, q AS (SELECT a.label AS a, b.label AS b, d.label AS c, list_transform(list_zip(a.v, b.v, d.v), lambda z: z[1] - z[2] + z[3]) AS w FROM c a, c b, c d WHERE a.label < 3 AND b.label < 3 AND d.label < 3 AND a.label <> b.label AND b.label <> d.label AND a.label <> d.label)
SELECT q.a, q.b, q.c, arg_min(c.label, (1 - {_cos('q.w', 'c.v')}, c.label)) AS nearest, round(min(1 - {_cos('q.w', 'c.v')}), 6) AS distance FROM q JOIN c ON c.label NOT IN (q.a, q.b, q.c) GROUP BY q.a, q.b, q.c""")
def analogies(t):
    """a - b + c, and the nearest other centroid; the centroids are as few as the labels."""
    c = S.centroids(t("embeddings"), "label", "embedding").select("label", "centroid")
    few = c.where("label < 3")
    a, b, d = (few.select(F.col("label").alias(n), F.col("centroid").alias(f"v{n}")) for n in "abc")
    q = a.join(b, F.col("a") != F.col("b")).join(d, (F.col("c") != F.col("a")) & (F.col("c") != F.col("b")))
    q = q.select("a", "b", "c", V.add(V.subtract(F.col("va"), F.col("vb")), F.col("vc")).alias("w"))
    far = q.join(c, ~F.col("label").isin(F.col("a"), F.col("b"), F.col("c"))).select("a", "b", "c", "label", V.cosine_distance(F.col("w"), F.col("centroid")).alias("d"))
    best = far.groupBy("a", "b", "c").agg(F.min(F.struct("d", "label")).alias("m"))
    return best.select("a", "b", "c", F.col("m.label").alias("nearest"), F.round("m.d", 6).alias("distance"))


@query("ST21", f"""
WITH {_V}, s AS (SELECT protocol, count(*) FILTER (WHERE state = expected) / count(expected) AS m, count(*) FILTER (WHERE state = 'O') / count(*) AS a FROM v GROUP BY protocol), u AS (SELECT protocol, 1 - (a - 0.25) / 0.75 AS tis, (m - 0.25) / 0.75 AS mss FROM s)
SELECT protocol, round(tis, 9) AS tis, round(mss, 9) AS mss, round(tis * mss, 9) AS product FROM u""")
def summary_scores(t):
    s = judged(t("events")).groupBy("protocol").agg((F.count_if(F.col("state") == F.col("expected")) / F.count("expected")).alias("m"), (F.count_if(F.col("state") == "O") / F.count(F.lit(1))).alias("a"))
    tis, mss = 1 - (F.col("a") - 0.25) / 0.75, (F.col("m") - 0.25) / 0.75
    return s.select("protocol", F.round(tis, 9).alias("tis"), F.round(mss, 9).alias("mss"), F.round(tis * mss, 9).alias("product"))


@query("ST26", f"""
WITH {_C}, p AS (SELECT {_cos('a.v', 'b.v')} AS s FROM c a JOIN c b ON a.label < b.label) SELECT round(avg(s), 6) AS mean_cosine, CASE WHEN avg(s) > 0.7 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS verdict FROM p""")
def cross_group_cosine(t):
    d = S.centroid_distances(S.centroids(t("embeddings"), "label", "embedding"), "label")
    mean = F.avg(1 - F.col("cosine_distance"))
    return d.agg(F.round(mean, 6).alias("mean_cosine"), F.when(mean > 0.7, "SIMILAR").otherwise("DIFFERENT").alias("verdict"))


@query("ST25", """
WITH s AS (SELECT event_type, count(*) FILTER (WHERE user_id % 40 = 0) AS a, count(*) FILTER (WHERE user_id % 40 <> 0) AS b FROM events GROUP BY event_type)
SELECT event_type, a / nullif(b, 0) < 0.1 OR a / nullif(b, 0) > 10 AS asymmetric, b / nullif(a, 0) > 10 AS reversed FROM s""")
def size_asymmetry(t):
    s = t("events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 40 == 0).alias("a"), F.count_if(F.col("user_id") % 40 != 0).alias("b"))
    ratio, back = F.col("a") / F.nullif("b", F.lit(0)), F.col("b") / F.nullif("a", F.lit(0))
    return s.select("event_type", ((ratio < 0.1) | (ratio > 10)).alias("asymmetric"), (back > 10).alias("reversed"))


@query("TK2 TK4", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 3")
def longest_by_language(t):
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return t("documents").select("lang", "doc_id", place.alias("place")).where("place <= 3")
