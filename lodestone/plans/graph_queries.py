"""Queries of the threshold graph over labels, and over finer groups of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graphs as G
from lodestone.operators import statistics as S
from lodestone.plans.registry import query

#: Parts of a label, by id, that make the finer groups.
PARTS = 4
#: The SQL unrolls walks up to this length; the graphs here have smaller diameters.
LONGEST = 9


def _groups(t, fine: bool):
    label = F.col("label") * PARTS + F.col("vec_id") % PARTS if fine else F.col("label")
    e = t("embeddings").select(label.cast("long").alias("label"), "embedding")
    table = S.centroids(e, "label", "embedding")
    return table.select(F.col("label").alias("node")), G.threshold_edges(S.centroid_distances(table, "label"), "l2")


def _sql(fine: bool) -> str:
    label = f"label * {PARTS} + vec_id % {PARTS}" if fine else "label"
    return f"""
m AS (SELECT ({label})::BIGINT AS node, i, avg(x) AS x FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
nodes AS (SELECT DISTINCT node FROM m),
l2 AS (SELECT p.node AS a, q.node AS b, sqrt(sum((p.x - q.x) * (p.x - q.x))) AS d FROM m p JOIN m q ON p.i = q.i AND p.node < q.node GROUP BY p.node, q.node),
g AS MATERIALIZED (SELECT a, b, d FROM l2 WHERE d < (SELECT quantile_cont(d, 0.3) FROM l2 WHERE d > 0)),
arcs AS MATERIALIZED (SELECT a AS u, b AS v FROM g UNION ALL SELECT b, a FROM g)"""


_WALKS = ", ".join(
    ["w0 AS MATERIALIZED (SELECT node AS s, node AS v, 1::DOUBLE AS n FROM nodes)"]
    + [f"w{k} AS MATERIALIZED (SELECT s, arcs.v, sum(n) AS n FROM w{k - 1} w JOIN arcs ON w.v = arcs.u GROUP BY s, arcs.v)" for k in range(1, LONGEST + 1)]
    + [f"walks AS ({' UNION ALL '.join(f'SELECT s, v, {k} AS k, n FROM w{k}' for k in range(LONGEST + 1))})", "paths AS MATERIALIZED (SELECT s, v, min(k) AS d, arg_min(n, k) AS n FROM walks GROUP BY s, v)"]
)


@query("ST18", f"WITH {_sql(False)} SELECT a, b, round(d, 6) AS distance FROM g")
def threshold_graph(t):
    _, edges = _groups(t, False)
    return edges.select("a", "b", F.round("l2", 6).alias("distance"))


@query("ST18", f"""
WITH {_sql(False)}
SELECT nodes.node AS label, count(u) AS degree, round(count(u)::DOUBLE / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality FROM nodes LEFT JOIN arcs ON node = u GROUP BY nodes.node""")
def degree_centrality(t):
    """Of each label: its edges in the threshold graph, and their share of all that it could have."""
    nodes, edges = _groups(t, False)
    ends = G.both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = nodes.join(ends, F.col("node") == F.col("u"), "left").join(F.broadcast(n), F.lit(True)).select(F.col("node").alias("label"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "n")
    return out.select("label", "degree", F.round(F.col("degree") / F.nullif(F.col("n") - 1, F.lit(0)), 6).alias("centrality"))


def _betweenness_sql(fine: bool) -> str:
    return f"""
WITH {_sql(fine)}, {_WALKS}, through AS (
  SELECT x.v AS node, sum(x.n * y.n / z.n) AS b FROM paths x JOIN paths y ON x.v = y.s JOIN paths z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d
  WHERE x.s < y.v AND x.v <> x.s AND x.v <> y.v GROUP BY x.v
), n AS (SELECT count(*) AS n FROM nodes)
SELECT nodes.node, round(coalesce(b, 0) * 2 / ((n - 1) * (n - 2)), 6) AS betweenness FROM nodes LEFT JOIN through ON nodes.node = through.node, n"""


@query("ST18", _betweenness_sql(False))
def label_betweenness(t):
    return G.betweenness(*_groups(t, False)).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("ST18", _betweenness_sql(True))
def group_betweenness(t):
    return G.betweenness(*_groups(t, True)).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("ST18", f"""
WITH {_sql(True)}, {_WALKS}, degree AS (SELECT u, count(*) AS k FROM arcs GROUP BY u),
closed AS (SELECT x.u, count(*) AS c FROM arcs x JOIN arcs y ON x.u = y.u AND x.v < y.v JOIN arcs z ON z.u = x.v AND z.v = y.v GROUP BY x.u),
c AS (SELECT avg(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(c, 0) / (k * (k - 1)) ELSE 0 END) AS clustering FROM nodes LEFT JOIN degree ON node = degree.u LEFT JOIN closed ON node = closed.u)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM paths) = (SELECT count(*) * count(*) FROM nodes) AS connected,
  CASE WHEN (SELECT count(*) FROM paths) = (SELECT count(*) * count(*) FROM nodes) THEN (SELECT max(d) FROM paths) END AS diameter, round(clustering, 6) AS clustering FROM c""")
def graph_properties(t):
    out = G.properties(*_groups(t, True))
    return out.withColumn("clustering", F.round("clustering", 6))


def _communities_sql(steps: int = 10) -> str:
    parts = [_sql(False), "m2 AS (SELECT count(*) AS twice FROM arcs)", "c0 AS MATERIALIZED (SELECT node, node AS c FROM nodes)"]
    for k in range(steps):
        parts.append(f"k{k} AS MATERIALIZED (SELECT c, count(u) AS k FROM c{k} LEFT JOIN arcs ON node = u GROUP BY c)")
        parts.append(f"e{k} AS MATERIALIZED (SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS n FROM g JOIN c{k} x ON g.a = x.node JOIN c{k} y ON g.b = y.node WHERE x.c <> y.c GROUP BY ALL)")
        parts.append(f"b{k} AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, n * twice - p.k * q.k AS gain FROM e{k} JOIN k{k} p ON a = p.c JOIN k{k} q ON b = q.c, m2) WHERE gain >= 0 ORDER BY gain DESC, a, b LIMIT 1)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT node, coalesce((SELECT a FROM b{k} WHERE b{k}.b = c{k}.c), c{k}.c) AS c FROM c{k})")
    return f"WITH {', '.join(parts)} SELECT node AS label, c AS community FROM c{steps}"


@query("ST18", _communities_sql())
def label_communities(t):
    """Communities of the threshold graph over labels, each named by its smallest label."""
    return G.communities(*_groups(t, False)).select(F.col("node").alias("label"), "community")
