"""Graphs as tables of edges: threshold graphs, shortest paths, betweenness, clustering and communities, by joins and aggregates.

Nothing is drawn to the driver but counts and single rows. Tables that a loop goes on from are written to the shared folder, and deleted when its result is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize, remove_table


def threshold_edges(distances: DataFrame, distance: str, share: float = 0.3) -> DataFrame:
    """a, b and the distance of the pairs that are nearer than the percentile of all positive distances."""
    cut = distances.where(F.col(distance) > 0).agg(F.percentile(distance, F.lit(share)).alias("__cut"))
    return distances.join(F.broadcast(cut), F.col(distance) < F.col("__cut")).select("a", "b", distance)


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) and (v, u) of each edge (a, b), once each; loops and nulls are left out."""
    real = edges.where("a <> b")
    return real.select(F.col("a").alias("u"), F.col("b").alias("v")).union(real.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()


def _levels(nodes: DataFrame, arcs: DataFrame, name: str) -> list[DataFrame]:
    """Breadth-first search from all nodes at once: the k-th table has (s, v, paths) for the nodes v at distance k of s, with the number of shortest paths."""
    levels = [materialize(nodes.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")), name)]
    while True:
        step = arcs.select("u", F.col("v").alias("w"))
        far = levels[-1].join(step, F.col("v") == F.col("u")).groupBy("s", "w").agg(F.sum("paths").alias("paths"))
        # What is a step from distance k lies at k - 1, k or k + 1.
        for seen in levels[-2:]:
            far = far.join(seen.select(F.col("s").alias("__s"), F.col("v").alias("__v")), (F.col("s") == F.col("__s")) & (F.col("w") == F.col("__v")), "left_anti")
        level = materialize(far.select("s", F.col("w").alias("v"), "paths"), name)
        if level.isEmpty():
            remove_table(level.sparkSession, level)
            return levels
        levels.append(level)


def _clear(tables: list[DataFrame]) -> None:
    for x in tables:
        remove_table(x.sparkSession, x)


def distances(nodes: DataFrame, edges: DataFrame, name: str = "paths") -> DataFrame:
    """s, v, distance, paths of all pairs that are connected, each node with itself included (distance 0). nodes: (node)."""
    arcs = materialize(both_ways(edges), name)
    levels = _levels(nodes, arcs, name)
    out = levels[0].withColumn("distance", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        out = out.unionByName(level.withColumn("distance", F.lit(k)))
    out = materialize(out.select("s", "v", "distance", "paths"), name)
    _clear([arcs, *levels])
    return out


def betweenness(nodes: DataFrame, edges: DataFrame, name: str = "betweenness") -> DataFrame:
    """node, betweenness: the share of shortest paths between others that go through a node, over all pairs of others (0 with fewer than three nodes).

    Breadth-first search from all nodes at once counts the paths; from the farthest level back, each node hands what depends on it to those before it
    (Brandes, 2001). Pairs of nodes are rows, so the work is that of nodes times edges, spread over the cluster by source; the number of jobs is twice the diameter.
    """
    arcs = materialize(both_ways(edges), name)
    levels = _levels(nodes, arcs, name)
    behind = materialize(levels[-1].withColumn("depends", F.lit(0.0)), name)
    total = [behind]
    for level in reversed(levels[:-1]):
        hand = behind.select("s", F.col("v").alias("w"), ((1 + F.col("depends")) / F.col("paths")).alias("part"))
        hand = hand.join(arcs, F.col("w") == F.col("v")).select(F.col("s").alias("__s"), F.col("u").alias("__u"), "part")
        hand = hand.groupBy("__s", "__u").agg(F.sum("part").alias("part"))
        here = level.join(hand, (F.col("s") == F.col("__s")) & (F.col("v") == F.col("__u")), "left")
        behind = materialize(here.select("s", "v", "paths", F.coalesce(F.col("paths") * F.col("part"), F.lit(0.0)).alias("depends")), name)
        total.append(behind)
    every = total[0]
    for x in total[1:]:
        every = every.unionByName(x)
    sums = every.where("s <> v").groupBy("v").agg(F.sum("depends").alias("depends"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = nodes.join(sums, F.col("node") == F.col("v"), "left").join(F.broadcast(n), F.lit(True))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    out = materialize(out.select("node", F.when(pairs > 0, F.coalesce("depends", F.lit(0.0)) / pairs).otherwise(0.0).alias("betweenness")), name)
    _clear([arcs, *levels, *total])
    return out


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, clustering: of the pairs of a node's neighbours, the share that is joined itself (0 with fewer than two)."""
    arcs = both_ways(edges)
    up = arcs.where("u < v")
    # Each triangle once, from its smallest node; a node's longer arcs meet in pairs.
    first, second = up.select("u", F.col("v").alias("x")), up.select(F.col("u").alias("u2"), F.col("v").alias("y"))
    closing = up.select(F.col("u").alias("cx"), F.col("v").alias("cy"))
    triangles = first.join(second, (F.col("u") == F.col("u2")) & (F.col("x") < F.col("y"))).join(closing, (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy")))
    closed = triangles.select(F.explode(F.array("u", "x", "y")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("closed"))
    degree = arcs.groupBy(F.col("u").alias("d")).agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.join(degree, F.col("node") == F.col("d"), "left").join(closed, F.col("node") == F.col("t"), "left")
    return out.select("node", F.when(F.col("degree") > 1, 2 * F.coalesce("closed", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))


def properties(nodes: DataFrame, edges: DataFrame, name: str = "properties") -> DataFrame:
    """One row: nodes, edges, connected, diameter (null where it isn't connected), clustering (the mean)."""
    pairs = distances(nodes, edges, name)
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = both_ways(edges).agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    far = pairs.agg(F.count(F.lit(1)).alias("reached"), F.max("distance").alias("far"))
    out = n.join(m, F.lit(True)).join(far, F.lit(True)).join(clustering(nodes, edges).agg(F.avg("clustering").alias("clustering")), F.lit(True))
    whole = F.col("reached") == F.col("nodes") * F.col("nodes")
    return out.select("nodes", "edges", whole.alias("connected"), F.when(whole, F.col("far")).alias("diameter"), "clustering")


def communities(nodes: DataFrame, edges: DataFrame, name: str = "communities") -> DataFrame:
    """node, community (its smallest node), by greedy merging: the two communities whose merger raises modularity most become one, until every merger lowers it.

    Gains are whole numbers (2 m edges between them - the product of their degrees), so that they are exact; of equal gains the smallest pair goes first. Merged edges are one row with a number,
    so the table shrinks with every step. A step is a job and the steps follow each other: this is for graphs of labels, not of documents.
    """
    spark = nodes.sparkSession
    arcs = both_ways(edges).where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).cast("long").alias("n"))
    links = materialize(arcs, name)
    twice = 2 * (links.agg(F.sum("n")).first()[0] or 0)
    ends = links.select(F.explode(F.array("a", "b")).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("degree"))
    of = materialize(nodes.join(ends, F.col("node") == F.col("e"), "left").select("node", F.col("node").alias("community"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree")), name)
    while True:
        weight = of.groupBy("community").agg(F.sum("degree").alias("k"))
        wa, wb = weight.select(F.col("community").alias("ca"), F.col("k").alias("ka")), weight.select(F.col("community").alias("cb"), F.col("k").alias("kb"))
        gain = F.col("n") * F.lit(twice).cast("long") - F.col("ka") * F.col("kb")
        best = links.join(wa, F.col("a") == F.col("ca")).join(wb, F.col("b") == F.col("cb")).select("a", "b", gain.alias("gain")).orderBy(F.desc("gain"), "a", "b").first()
        if best is None or best.gain < 0:
            break
        name_of = lambda c: F.when(F.col(c) == best.b, F.lit(best.a)).otherwise(F.col(c))  # noqa: B023, E731
        new = links.select(name_of("a").alias("x"), name_of("b").alias("y"), "n").where("x <> y")
        new = new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
        old, links, of = [links, of], materialize(new, name), materialize(of.withColumn("community", name_of("community")), name)
        _clear(old)
    out = of.select("node", "community")
    remove_table(spark, links)
    return out


def modularity(of: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the modularity of a division (node, community)."""
    arcs = both_ways(edges)
    left, right = of.select(F.col("node").alias("x"), F.col("community").alias("cx")), of.select(F.col("node").alias("y"), F.col("community").alias("cy"))
    ends = arcs.join(left, F.col("u") == F.col("x")).join(right, F.col("v") == F.col("y"))
    by = ends.groupBy("cx").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("cx") == F.col("cy")).alias("inside"))
    m = arcs.agg(F.count(F.lit(1)).alias("m"))
    return by.join(F.broadcast(m), F.lit(True)).agg(F.sum(F.col("inside") / F.col("m") - F.col("k") * F.col("k") / (F.col("m") * F.col("m"))).alias("modularity"))
