"""Distributions against closed forms, loops and perturbations against brute force, shares of variance against their sums."""

import hashlib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import dihedral, special
from lodestone.operators import perturb, statistics


def test_incomplete_beta_is_the_binomial_tail():
    for a, b, x in itertools.product((1, 2, 5, 40), (1, 3, 17), (0.01, 0.3, 0.5, 0.9, 0.999)):
        n, p = a + b - 1, Fraction(x)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(a, n + 1))
        assert special.incomplete_beta(a, b, x) == pytest.approx(float(tail), rel=1e-11)
    assert special.incomplete_beta(2, 3, [-1, 0, 1, 2]).tolist() == [0, 0, 1, 1]
    assert special.incomplete_beta(5e4, 7e4, 5 / 12) == pytest.approx(0.5, abs=2e-3)


def test_t_and_normal():
    t = np.array([0, 0.3, 1, 4, 50])
    assert special.t_tails(t, 1) == pytest.approx(1 - 2 / math.pi * np.arctan(t), abs=1e-13)
    assert special.t_tails(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-13)
    assert special.t_tails([2.2281388519649385, 1.6448536269514722], [10, 1e9]) == pytest.approx([0.05, 0.1], abs=1e-8)
    assert special.normal_upper([0, 1.959963984540054, -1.959963984540054]) == pytest.approx([0.5, 0.025, 0.975], abs=1e-12)


def test_exact_intervals(spark):
    low, high = special.share_interval([0, 10, 5, 0, 1], [10, 10, 10, 0, 1])
    assert low == pytest.approx([0, 0.025 ** (1 / 10), 0.18708602844739855, 0, 0.025], abs=1e-9)
    assert high == pytest.approx([1 - 0.025 ** (1 / 10), 1, 0.8129139715526015, 1, 1], abs=1e-9)
    df = spark.createDataFrame([(1, 3, 10), (2, None, 10), (3, 1, None)], "id int, k int, n int")
    got = {r.id: (r.i.low, r.i.high) for r in df.select("id", special.clopper_pearson(F.col("k"), F.col("n"), 0.9).alias("i")).collect()}
    assert got[2] == got[3] == (None, None)
    p = got[1]
    assert special.incomplete_beta(3, 8, p[0]) == pytest.approx(0.05) and 1 - special.incomplete_beta(4, 7, p[1]) == pytest.approx(0.05)


def test_p_of_effect_size(spark):
    df = spark.createDataFrame([(float(x), x < 4) for x in range(9)], "v double, a boolean")
    r = statistics.effect_size(statistics.two_samples(df, "v", F.col("a"))).first()
    assert r.p == pytest.approx(float(special.t_tails(r.t, 7))) and 0 < r.p < 0.01
    same = statistics.effect_size(statistics.two_samples(df.withColumn("v", F.lit(1.0)), "v", F.col("a"))).first()
    assert same.t is None and same.p is None


def brute_product(path):
    """States moved one by one: an element is known by where it takes O and C."""
    move = lambda g, x: ((1 - x if dihedral.ELEMENTS.index(g) >= 4 else x) + dihedral.ELEMENTS.index(g) % 4) % 4
    at = list(range(4))
    for g in path:
        at = [move(g, x) for x in at]
    return next(e for e in dihedral.ELEMENTS if [move(e, x) for x in range(4)] == at)


def test_holonomy_over_partitions(spark):
    rng = random.Random(8)
    rows = [(s, i, rng.choice([*dihedral.ELEMENTS, None]), rng.choice("OCLN")) for s, n in ((1, 400), (2, 1), (3, 37), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "s int, at int, g string, state string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.s: r for r in dihedral.loops(df, "s", ["at"], "g", "state").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in (1, 2, 3, None):
        own = [r for r in rows if r[0] == s]
        element = brute_product([g or "e" for _, _, g, _ in own])
        moved = (lambda x, k=dihedral.ELEMENTS.index(element): ((1 - x if k >= 4 else x) + k % 4) % 4)("OCLN".index(own[0][3]))
        assert (got[s].steps, got[s].element, got[s].initial, got[s].final, got[s].matched) == (len(own), element, own[0][3], own[-1][3], "OCLN"[moved] == own[-1][3])


def test_variance_shares(spark):
    rng = random.Random(4)
    rows = [(a, b, [a + rng.gauss(0, 0.3), b * 2 + rng.gauss(0, 0.3), float(a * b)]) for a in range(3) for b in range(2) for _ in range(5)] + [(0, 0, None), (0, 1, [1.0])]
    out = {r.factor: r for r in statistics.variance_shares(spark.createDataFrame(rows, "a int, b int, v array<double>"), "a", "b", "v", 3).collect()}
    v = np.array([r[2] for r in rows[:-2]])
    a, b = np.array([r[0] for r in rows[:-2]]), np.array([r[1] for r in rows[:-2]])
    total = ((v - v.mean(0)) ** 2).sum()
    of = lambda f: sum(len(v[f == k]) * ((v[f == k].mean(0) - v.mean(0)) ** 2).sum() for k in set(f.tolist()))
    assert out["first"].squares == pytest.approx(of(a)) and out["second"].squares == pytest.approx(of(b)) and out["total"].squares == pytest.approx(total)
    assert sum(out[k].squares for k in ("first", "second", "interaction", "within")) == pytest.approx(total)
    assert [out[k].degrees for k in ("first", "second", "interaction", "within", "total")] == [2, 1, 2, 24, 29]
    assert sum(out[k].eta_squared for k in ("first", "second", "interaction", "within")) == pytest.approx(1)
    assert statistics.variance_shares(spark.createDataFrame([], "a int, b int, v array<double>"), "a", "b", "v", 3).count() == 0


SYNONYMS, NAMES, DETAILS = {"help": ["aid", "assist"], "kind": ["nice"]}, ["Anna", "Ben", "Cora"], ["It rained.", "A dog barked."]


def brute_surface(i, text):
    u = lambda *salt: int(hashlib.md5(":".join([str(i), *map(str, salt)]).encode()).hexdigest()[:8], 16) / 2**32
    pick = lambda xs, d: xs[int(d * len(xs))]
    ops = [n for _, n in sorted((u(f"op {n}"), n) for n in ("synonym", "name", "detail"))][: 1 if u("count") < 0.5 else 2]
    for op in ops:
        if op == "synonym":
            words = text.split()
            for k, w in enumerate(words):
                bare = w.lower().strip(".,!?")
                if bare in SYNONYMS and u("swap", k) < 0.3:
                    new = pick(SYNONYMS[bare], u("synonym", k))
                    words[k] = (new.capitalize() if w[0].isupper() else new) + w[len(bare) :]
            text = " ".join(words)
        elif op == "name":
            for n in NAMES:
                if n in text:
                    text = text.replace(n, pick([x for x in NAMES if x != n], u("name")))
                    break
        elif u("insert") < 0.7 and len(text) > 20:
            detail = pick(DETAILS, u("detail"))
            places = [k + 1 for k, c in enumerate(text) if c in ",."][:3]
            if u("end") < 0.5 or not places:
                text = text.rstrip() + " " + detail.strip()
            else:
                at = pick(places, u("place"))
                text = text[:at] + " " + detail + text[at:]
    return ops, text


def test_random_surface(spark):
    rng = random.Random(6)
    words = ["Help", "help,", "kind", "Kind.", "Anna", "Ben", "must", "the", "child,", "and", "go.", "helpful"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.ops, r.text) for r in perturb.random_surface(df.repartition(7), "id", "text", SYNONYMS, NAMES, DETAILS).collect()}
    assert got == {i: brute_surface(i, x) for i, x in rows}
    assert {len(o) for o, _ in got.values()} == {1, 2} and sum(x != got[i][1] for i, x in rows) > 100
