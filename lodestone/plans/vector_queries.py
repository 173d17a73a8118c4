"""Vectors and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import statistics as S
from lodestone.plans.registry import query

_C = """l AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), b AS (SELECT label, d, avg(x) AS c, stddev_pop(x) AS s, count(*) AS n FROM l GROUP BY label, d),
c AS (SELECT label, max(n) AS n, list(c ORDER BY d) AS centroid, avg(s) AS spread FROM b GROUP BY label)"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}) + 1e-9))"


@query("AG19", f"WITH {_C} SELECT label, n, round(centroid[1], 6) AS first, round(centroid[64], 6) AS last, round(spread, 6) AS spread FROM c")
def centroids(t):
    c = S.centroids(t("embeddings"), "label", "embedding")
    return c.select("label", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(63)), 6).alias("last"), F.round("spread", 6).alias("spread"))


@query("JN10 ST1 ST2", f"""
WITH {_C} SELECT a.label AS a, b.label AS b, round(1 - {_cos('a.centroid', 'b.centroid')}, 6) AS cosine_distance, round(sqrt(list_sum(list_transform(list_zip(a.centroid, b.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS l2
FROM c a JOIN c b ON a.label < b.label""")
def centroid_distances(t):
    d = S.centroid_distances(S.centroids(t("embeddings"), "label", "embedding"), "label")
    return d.select("a", "b", F.round("cosine_distance", 6).alias("cosine_distance"), F.round("l2", 6).alias("l2"))


@query("AG20", f"""
WITH {_C}, d AS (SELECT e.vec_id AS id, c.label, 1 - {_cos('e.embedding', 'c.centroid')} AS d FROM embeddings e JOIN c ON c.label <> e.label)
SELECT id, arg_min(label, d) AS label, round(min(d), 6) AS distance FROM d GROUP BY id""")
def nearest_other_centroid(t):
    e = t("embeddings")
    out = S.nearest(e, "embedding", "vec_id", S.centroids(e, "label", "embedding"), "label", F.col("label"))
    return out.withColumn("distance", F.round("distance", 6))


@query("ST3", f"""
WITH {_C}, g AS (SELECT list_transform(list_zip((SELECT centroid FROM c WHERE label = 0), (SELECT centroid FROM c WHERE label = 1)), lambda z: z[1] - z[2]) AS w),
p AS (SELECT label, {_dot('embedding', 'w')} / (sqrt({_dot('w', 'w')}) + 1e-9) AS s FROM embeddings, g WHERE label IN (0, 1))
SELECT round(avg(CASE WHEN label = 0 THEN s END), 6) AS first, round(avg(CASE WHEN label = 1 THEN s END), 6) AS second, round(avg(((s > (SELECT avg(s) FROM p)) = (label = 0))::INT::DOUBLE), 6) AS accuracy FROM p""")
def mean_difference_direction(t):
    e = t("embeddings")
    c = S.centroids(e.where("label IN (0, 1)"), "label", "embedding")
    w = c.where("label = 0").select(F.col("centroid").alias("p")).crossJoin(c.where("label = 1").select(F.col("centroid").alias("q"))).select(V.unit(V.subtract(F.col("p"), F.col("q"))).alias("w"))
    s = e.where("label IN (0, 1)").crossJoin(F.broadcast(w)).select("label", V.dot(F.col("embedding"), F.col("w")).alias("s"))
    mean = s.agg(F.avg("s").alias("m"))
    right = ((F.col("s") > F.col("m")) == (F.col("label") == 0)).cast("double")
    return s.crossJoin(F.broadcast(mean)).agg(F.round(F.avg(F.when(F.col("label") == 0, F.col("s"))), 6).alias("first"), F.round(F.avg(F.when(F.col("label") == 1, F.col("s"))), 6).alias("second"), F.round(F.avg(right), 6).alias("accuracy"))


@query("ST4", f"""
WITH {_C} SELECT e.label, round(avg({_cos('e.embedding', 'c.centroid')}), 6) AS mean, round(stddev_pop({_cos('e.embedding', 'c.centroid')}), 6) AS deviation FROM embeddings e JOIN c ON e.label = c.label GROUP BY e.label""")
def consistency(t):
    e = t("embeddings")
    rows = e.join(S.centroids(e, "label", "embedding"), "label").select("label", V.cosine(F.col("embedding"), F.col("centroid")).alias("c"))
    return rows.groupBy("label").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c"), 6).alias("deviation"))


#: Integrals by Simpson's rule, from 0 to the absolute value: what p is held against.
_SIMPSON = "(list_sum(list_transform(range(0, {n} + 1), lambda i: (CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)::DOUBLE * {f})) * ({to}) / {n} / 3)"


def normal_upper_sql(z: str) -> str:
    """P(Z >= z) in SQL."""
    to = f"least(abs({z}), 12)::DOUBLE"
    area = _SIMPSON.format(n=2000, to=to, f=f"exp(-(({to}) * i / 2000) * (({to}) * i / 2000) / 2) / sqrt(2 * pi())")
    return f"(0.5::DOUBLE - sign({z}) * {area})"


def t_tails_sql(t: str, df: str) -> str:
    """P(|T| >= |t|) in SQL."""
    to = f"least(abs({t}), 40)::DOUBLE"
    area = _SIMPSON.format(n=4000, to=to, f=f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0) - ln(({df}) * pi()) / 2 - (({df}) + 1) / 2.0 * ln(1 + (({to}) * i / 4000) * (({to}) * i / 4000) / ({df})))")
    return f"(1::DOUBLE - 2 * {area})"


@query("ST8 ST9 ST11", f"""
WITH s AS (SELECT count(CASE WHEN event_type = 'view' THEN value END) AS n1, avg(CASE WHEN event_type = 'view' THEN value END) AS m1, var_pop(CASE WHEN event_type = 'view' THEN value END) AS v1,
  count(CASE WHEN event_type <> 'view' THEN value END) AS n2, avg(CASE WHEN event_type <> 'view' THEN value END) AS m2, var_pop(CASE WHEN event_type <> 'view' THEN value END) AS v2 FROM events)
SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, round((m1 - m2) / sqrt((n1 * v1 + n2 * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, round(m1 / m2, 6) AS ratio,
  round({t_tails_sql("(m1 - m2) / sqrt((n1 * v1 + n2 * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))", "n1 + n2 - 2")}, 6) AS p FROM s""")
def effect_size(t):
    e = S.effect_size(S.two_samples(t("events"), "value", F.col("event_type") == "view"))
    return e.select("n1", "n2", *[F.round(c, 6).alias(c) for c in ("cohens_d", "t", "ratio", "p")])


@query("ST10", f"""
WITH r AS (SELECT event_type = 'view' AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM events WHERE event_type IN ('view', 'error')),
u AS (SELECT count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, sum(k) FILTER (WHERE a) - count(*) FILTER (WHERE a) * (count(*) FILTER (WHERE a) + 1) / 2.0 AS u FROM r),
c AS (SELECT sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY k)),
z AS (SELECT n1, n2, u, (u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, c)
SELECT n1, n2, round(u, 3) AS u, round({normal_upper_sql("z")}, 6) AS p FROM z""")
def rank_test(t):
    out = S.mann_whitney(t("events").where("event_type IN ('view', 'error')"), "value", F.col("event_type") == "view")
    return out.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), F.round("u", 3).alias("u"), F.round("p_greater", 6).alias("p"))


@query("ST12", f"""
WITH s AS (SELECT lang, count(*) AS n, sum(toxic) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, round((k / n - 0.1) / sqrt(0.09 / n), 6) AS z, round(2 * asin(sqrt(k / n)) - 2 * asin(sqrt(0.1)), 6) AS h, round({normal_upper_sql("(k / n - 0.1) / sqrt(0.09 / n)")}, 6) AS p FROM s""")
def proportion_test(t):
    s = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    z, p, h = S.one_proportion(F.col("k"), F.col("n"), 0.1)
    return s.select("lang", F.round(z, 6).alias("z"), F.round(h, 6).alias("h"), F.round(p, 6).alias("p"))


@query("ST14", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def correlation(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


#: Labels that no state stands for count as one null state, a group of its own.
_STATE = "CASE WHEN label % 4 = 3 THEN 'NONE' ELSE 's' || CAST(label AS STRING) END"


@query("ST28", f"""
WITH {_C.replace('SELECT label, unnest', f'SELECT {_STATE} AS label, unnest')} SELECT a.label AS a, b.label AS b, round(1 - {_cos('a.centroid', 'b.centroid')}, 6) AS cosine_distance, round(sqrt(list_sum(list_transform(list_zip(a.centroid, b.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS l2
FROM c a JOIN c b ON a.label < b.label""")
def state_distances(t):
    d = S.centroid_distances(S.centroids(t("embeddings").select(F.expr(_STATE).alias("label"), "embedding"), "label", "embedding"), "label")
    return d.select("a", "b", F.round("cosine_distance", 6).alias("cosine_distance"), F.round("l2", 6).alias("l2"))


@query("ST7")
def bootstrap_interval(t):
    return S.bootstrap(t("events"), "value", "event_id", 200)


def _vectors(df):
    from pyspark.ml.functions import array_to_vector

    return df.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query("ST5")
def principal_components(t):
    """Share of the variance by component, and how many components have more than 90 %, 95 % and 99 % of it."""
    from pyspark.ml.feature import PCA

    v = _vectors(t("embeddings"))
    model = PCA(k=64, inputCol="features", outputCol="pc").fit(v)
    share = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance.toArray())]
    out = v.sparkSession.createDataFrame(share, "component int, share double")
    from pyspark.sql import Window as W

    # As many rows as components.
    out = out.withColumn("cumulative", F.sum("share").over(W.orderBy("component")))
    first = lambda test: F.min(F.when(test, F.col("component"))).over(W.partitionBy())
    c = F.col("cumulative")
    return out.withColumns({"above_90": first(c > 0.9), "from_95": first(c >= 0.95), "from_99": first(c >= 0.99)})


@query("ST27")
def component_labels(t):
    """The two lowest and two highest labels on each of the first five principal components."""
    from pyspark.ml.feature import PCA

    e = t("embeddings")
    model = PCA(k=5, inputCol="features", outputCol="pc").fit(_vectors(e))
    # Five components of as many numbers as a vector has.
    return S.extreme_labels(S.centroids(e, "label", "embedding"), "label", model.pc.toArray().T.tolist())


@query("ST6")
def linear_probe(t):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    v = _vectors(t("embeddings")).withColumn("train", F.substring(F.md5(F.concat(F.lit("42:"), F.col("vec_id").cast("string"))), 1, 8) <= "b3333332")
    scaler = StandardScaler(inputCol="features", outputCol="x", withMean=True).fit(v.where("train"))
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=50).fit(scaler.transform(v.where("train")))
    scored = model.transform(scaler.transform(v.where("NOT train")))
    n = t("embeddings").agg(F.countDistinct("label").alias("k"))
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")).crossJoin(n).select("n", "accuracy", (1 / F.col("k")).alias("chance"), (F.col("accuracy") > 1 / F.col("k") + 0.15).alias("linear"))


@query("ST16")
def cluster_composition(t):
    from pyspark.ml.clustering import KMeans

    v = _vectors(t("embeddings"))
    out = KMeans(k=10, seed=42, featuresCol="features", predictionCol="cluster").fit(v).transform(v)
    n = out.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cluster").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("modal_label"), F.max("n").alias("modal_n"))


@query("ST15")
def cluster_numbers(t):
    """Silhouette (squared Euclidean) of 2 to 14 clusters over all rows, and which number is best (the smaller of equal ones)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    # Read and converted once; what an executor loses is read again.
    v = _vectors(t("embeddings")).persist()
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette", distanceMeasure="squaredEuclidean")
    found = [(k, float(evaluator.evaluate(KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster").fit(v).transform(v)))) for k in range(2, 15)]
    v.unpersist()
    best = max(found, key=lambda x: (x[1], -x[0]))[0]
    return v.sparkSession.createDataFrame([(k, s, k == best) for k, s in found], "k int, silhouette double, best boolean")
