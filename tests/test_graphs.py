"""Graphs against brute force over all paths and all divisions."""

import random
from collections import deque
from itertools import combinations

import pytest

from lodestone.operators import graphs as G


def tables(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(edges, "a long, b long")


def shortest(n, edges):
    """All shortest paths of all pairs, as lists of nodes."""
    near = {i: sorted({b for a, b in edges if a == i} | {a for a, b in edges if b == i}) for i in range(n)}
    out = {}
    for s in range(n):
        found, todo = {s: [[s]]}, deque([s])
        dist = {s: 0}
        while todo:
            u = todo.popleft()
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    found[v] = []
                    todo.append(v)
                if dist[v] == dist[u] + 1:
                    found[v] += [p + [v] for p in found[u]]
        out |= {(s, v): ps for v, ps in found.items()}
    return out


def brute_betweenness(n, edges):
    paths = shortest(n, edges)
    total = dict.fromkeys(range(n), 0.0)
    for s, v in combinations(range(n), 2):
        for p in paths.get((s, v), []):
            for x in p[1:-1]:
                total[x] += 1 / len(paths[s, v])
    return {x: b * 2 / ((n - 1) * (n - 2)) for x, b in total.items()}


def some_graph(seed, n, m):
    rng = random.Random(seed)
    return sorted(rng.sample(list(combinations(range(n), 2)), m))


GRAPHS = [
    (5, [(0, 1), (1, 2), (2, 3), (3, 4)]),
    (6, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)]),  # two shortest paths between 0 and 3
    (7, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]),  # two parts and a lone node
    (12, some_graph(3, 12, 20)),
]


@pytest.mark.parametrize(("n", "edges"), GRAPHS)
def test_betweenness(spark, n, edges):
    nodes, table = tables(spark, n, edges + [(b, a) for a, b in edges[:2]] + [(0, 0)])
    got = {r.node: r.betweenness for r in G.betweenness(nodes, table).collect()}
    assert got == pytest.approx(brute_betweenness(n, edges))


def test_distances_and_properties(spark):
    n, edges = GRAPHS[3]
    nodes, table = tables(spark, n, edges)
    paths = shortest(n, edges)
    assert {(r.s, r.v): (r.distance, r.paths) for r in G.distances(nodes, table).collect()} == {k: (len(ps[0]) - 1, len(ps)) for k, ps in paths.items()}
    r = G.properties(nodes, table).first()
    pairs = set(edges)
    share = 0
    for i in range(n):
        near = sorted({b for a, b in edges if a == i} | {a for a, b in edges if b == i})
        k = len(near)
        share += sum(p in pairs for p in combinations(near, 2)) / (k * (k - 1) / 2) if k > 1 else 0
    assert (r.nodes, r.edges, r.connected) == (n, len(edges), len(paths) == n * n) and r.clustering == pytest.approx(share / n)
    assert r.diameter == (max(len(ps[0]) - 1 for ps in paths.values()) if r.connected else None)
    parts = G.properties(*tables(spark, *GRAPHS[2])).first()
    assert not parts.connected and parts.diameter is None


def score(of, edges):
    m = len(edges)
    degree = {x: sum(x in e for e in edges) for x in of}
    return sum(((sum(of[a] == c == of[b] for a, b in edges)) / m) - (sum(degree[x] for x in of if of[x] == c) / (2 * m)) ** 2 for c in set(of.values()))


def brute_communities(n, edges):
    of = {i: i for i in range(n)}
    while True:
        pairs = sorted({tuple(sorted((of[a], of[b]))) for a, b in edges if of[a] != of[b]})
        if not pairs:
            return of
        merged = [(round(score({x: (p[0] if c == p[1] else c) for x, c in of.items()}, edges) - score(of, edges), 12), p) for p in pairs]
        gain, (a, b) = max(merged, key=lambda x: (x[0], -x[1][0], -x[1][1]))
        if gain < 0:
            return of
        of = {x: (a if c == b else c) for x, c in of.items()}


@pytest.mark.parametrize(("n", "edges"), [*GRAPHS[1:3], (9, [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3), (6, 7), (7, 8), (6, 8), (5, 6)])])
def test_communities(spark, n, edges):
    nodes, table = tables(spark, n, edges)
    found = G.communities(nodes, table)
    got = {r.node: r.community for r in found.collect()}
    want = brute_communities(n, edges)
    assert got == want
    assert G.modularity(found, table).first()[0] == pytest.approx(score(want, edges))


def test_without_edges(spark):
    nodes, table = tables(spark, 3, [(1, 1)])
    assert {r.betweenness for r in G.betweenness(nodes, table).collect()} == {0.0}
    assert {(r.node, r.community) for r in G.communities(nodes, table).collect()} == {(0, 0), (1, 1), (2, 2)}
    empty = G.betweenness(nodes.where("false"), table)
    assert empty.count() == 0


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0), (0, 3, 0.0)], "a int, b int, l2 double")
    assert {(r.a, r.b) for r in G.threshold_edges(df, "l2", 0.5).collect()} == {(0, 1), (0, 3)}
