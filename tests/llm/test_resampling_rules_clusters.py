"""Quality rules, centroid clustering and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import centroid_clustering as cc
from lodestone.llm import importance_resampling as ir
from lodestone.llm import quality_rules as qr

from .conftest import edge_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def brute_rates(counts):
    n, chars, symbols, lines, same, repeated = counts
    return {"word_length": chars * 100 // n if n else None, "symbol_rate": symbols * 1000 // chars if chars else None, "line_rate": same * 1000 // lines if lines else None, "repeat_rate": repeated * 1000 // n if n else None}


def brute_rules(rows, fence, least):
    """rows: (doc_id, text, lang, source) -> (doc_id, the counts, base_failed, kept, failed)."""
    values = [(lang, source, brute_counts(x)) for _, x, lang, source in rows]

    def low_high(which, rate):
        found = sorted(v for lang, source, c in values if c[0] and which(lang, source) and (v := brute_rates(c)[rate]) is not None)
        cut = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
        if not found:
            return None
        q1, q3 = (cut(found[-(-len(found) * k // 4) - 1]) for k in (1, 3))
        reach = fence * max(q3 - q1, qr.RATES[rate])
        return q1 - reach, q3 + reach

    out = []
    for i, x, lang, source in rows:
        c = brute_counts(x)
        tests = [lambda a, b, lang=lang, source=source: (a, b) == (lang, source), lambda a, b, lang=lang: a == lang, lambda a, b: True]
        which = next((w for w in tests[:2] if sum(1 for a, b, k in values if k[0] and w(a, b)) >= least), tests[2])
        failed = []
        for rate in qr.RATES:
            v, limit = brute_rates(c)[rate], low_high(which, rate)
            if v is not None and limit and not limit[0] <= v <= limit[1]:
                failed.append(rate)
        base = c[0] < 50 or 100 * c[5] > 50 * c[0]
        out.append((i, c[0], c[1], c[2], c[4], c[5], base, not base and not failed, ",".join(failed)))
    return sorted(out, key=str)


def rule_rows():
    rng = random.Random(3)
    rows = [(i, x, "en", "a") for i, x in edge_rows()]
    rows += [(100 + i, sentence(rng, rng.randrange(40, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    rows += [(300 + i, " ".join(w + rng.choice(["###", "$$", "&"]) for w in sentence(rng, 80).split()), "en", "b") for i in range(6)]
    rows += [(310, " ".join(w * 8 for w in sentence(rng, 70).split()), "de", "a"), (311, "\n".join(["the same line of words"] * 20 + [sentence(rng, 60)]), "en", "a"), (312, sentence(rng, 60), "xx", "rare")]
    return rows


@pytest.mark.parametrize(("fence", "least"), [(6, 100), (2, 10), (0, 1)])
def test_quality_rules(spark, fence, least):
    rows = rule_rows()
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "doc_id long, text string, lang string, source string, limits string, kept boolean").repartition(6)
    got = sorted(map(tuple, qr.quality_rules(df, fence=fence, least_rows=least).collect()), key=str)
    assert got == brute_rules(rows, fence, least)
    if fence == 6:
        symbols = [r for r in got if r[0] is not None and 300 <= r[0] < 306]
        assert len(symbols) == 6 and all("symbol_rate" in r[8] and not r[7] for r in symbols)


def test_quality_rules_heavy_groups_by_shuffle(spark, monkeypatch):
    """No group counts as heavy: all go through the shuffled join, with the same rows."""
    rows = rule_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(qr, "HEAVY", 1)
    assert sorted(map(tuple, qr.quality_rules(df, least_rows=20).collect()), key=str) == brute_rules(rows, 6, 20)


def test_sketches_merge(spark):
    """The sketch of a union is the sum of the sketches, and quantiles are right to a 64th."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice("cd"), *(rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(4))) for _ in range(3000)]
    df = spark.createDataFrame(rows, ["lang", "source", *qr.RATES])
    once = qr.sketches(df, ["lang"])
    parts = qr.merged(qr.sketches(df, ["lang", "source"]), ["lang"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, parts.collect()))
    for r in qr.limits(once, ["lang"], fence=1).collect():
        for k, rate in enumerate(qr.RATES):
            found = sorted(x[2 + k] for x in rows if x[0] == r.lang)
            q1, q3 = found[-(-len(found) // 4) - 1], found[-(-len(found) * 3 // 4) - 1]
            assert abs(r.low[rate] - (q1 - (q3 - q1))) <= (q1 + q3) / 32 + 1 and abs(r.high[rate] - (q3 + q3 - q1)) <= (q1 + q3) / 32 + 1


def test_drop_bad(spark, empty):
    rows = rule_rows()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, kept long")
    kept = qr.drop_bad(df)
    assert kept.columns == df.columns
    want = [r[0] for r in brute_rules(rows, 6, 100) if r[7]]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())
    assert qr.quality_rules(empty.withColumns({"lang": F.lit("a"), "source": F.lit("b")})).count() == 0


def test_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "ab " * 200_000, "en", "a"), (2, "\n".join(f"w{i}" for i in range(100_000)), "en", "a")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in qr.quality_rules(df).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (200_000, 200_000, True)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].n_dup_lines) == (100_000, 0, 0)


def brute_clusters(rows, k, rounds, seed=3):
    kept = [(i, e) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    ints = [[math.floor(1024 * x) for x in e] for _, e in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"{seed}:{kept[j][0]}".encode()).hexdigest()))
    centroids = [list(ints[j]) for j in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for v in ints]
        for j in range(len(centroids)):
            own = [v for v, a in zip(ints, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [near(v) for v in ints]
    whole = [sum(d for d, a in found if a == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda d: d if d < 1 << 63 else None
    return sorted(((i, j, fit(d), fit(whole[j]), fit(sum(whole)), sha[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def vector_rows(rng, n):
    heads = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(5)]
    rows = [(i, [h + rng.gauss(0, 0.5) for h in rng.choice(heads)]) for i in range(n)]
    good = rows[0][1]
    rows += [(n, None), (n + 1, []), (n + 2, good[:63]), (n + 3, [*good, 1.0]), (n + 4, [None, *good[1:]]), (n + 5, [math.nan, *good[1:]]), (n + 6, [math.inf, *good[1:]]), (7, rows[7][1]), (7, rows[7][1]), (n + 7, good), (n + 8, [0.0] * 64)]
    return rows


def test_centroid_clustering(spark):
    rows = vector_rows(random.Random(11), 300)
    df = spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance int, centroid string").repartition(7)
    got = sorted((tuple(r)[:6] for r in cc.centroid_clustering(df).collect()), key=str)
    assert got == brute_clusters(rows, 8, 10)
    assert len({r[1] for r in got}) > 3


def test_ties_go_to_the_smaller_number(spark):
    """Equal first centroids: the first gets all; a vector between two goes to the smaller."""
    rows = [(i, [float(i % 2)] * 64) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r)[:6] for r in cc.centroid_clustering(df, clusters=6).collect()), key=str) == brute_clusters(rows, 6, 10)


def test_vectors_beyond_longs(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.choice([0, 0, 6, 30, 300]) for _ in range(64)]) for i in range(40)] + [(50 + i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((tuple(r)[:6] for r in cc.centroid_clustering(df, clusters=5, rounds=3).collect()), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in brute_clusters(rows, 5, 3)] and got == brute_clusters(rows, 5, 3)
    small = spark.createDataFrame([(None, [1.0] * 64), (1, [2.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r.cluster for r in cc.centroid_clustering(small).collect()) == [0, 1]
    assert cc.centroid_clustering(small.where("false")).count() == 0


def test_screening_prunes_and_loses_nothing():
    rng = np.random.default_rng(4)
    scales = 2000 * rng.random((6, 8)).repeat(8, 1)
    x = (scales[rng.integers(0, 6, 3000)] + rng.normal(0, 100, (3000, 64))).astype(np.int64)
    centroids = x[:8].copy()
    best, least, taken = cc.nearest(x, cc.segment_norms(x), centroids)
    exact = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == exact.argmin(1)).all() and (least == exact.min(1)).all()
    assert taken < 0.5 * x.shape[0] * 8


def test_limbs():
    for v in (0, 1, -1, 1 << 40, -(1 << 200) + 3, (1 << 63) - 1):
        assert sum(x << (cc.LIMB * i) for i, x in enumerate(cc._limbs(v))) == v


def brute_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_ranks(rows, target, buckets=10_000, least=20, percent=25):
    hashed = lambda fs: Counter(zlib.crc32(f.encode()) % buckets for f in fs)
    s, t = Counter(), Counter()
    for _, x in rows:
        s += hashed(brute_features(x)[1])
    for x in target:
        t += hashed(brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in rows:
        n, fs = brute_features(x)
        weight = sum(gain(b) * m for b, m in hashed(fs).items()) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return out


def test_importance_ranks(spark):
    rng = random.Random(9)
    rows = edge_rows() + [(200 + i, sentence(rng, rng.randrange(10, 60)) + " É über 12x") for i in range(200)]
    rows += [(600, sentence(rng, 30))] * 5 + [(None, sentence(rng, 40))]
    target = [sentence(rng, 50) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, score string, bucket int").repartition(9)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = sorted((tuple(r) for r in ir.importance_ranks(df, bench).collect()), key=str)
    want = brute_ranks(rows, target)
    assert [r[:4] for r in got] == [tuple(r[:4]) for r in sorted(want, key=lambda r: str(tuple(r[:5])))] or sorted(r[:4] for r in map(list, got) if r[0] is not None) == sorted(r[:4] for r in want if r[0] is not None)
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(ranked) + 1))
    best = sorted((r for r in want if r[4] is not None), key=lambda r: r[4])
    assert [(r[0], r[3]) for r in ranked] == [(r[0], r[3]) for r in best]


def test_ranks_over_many_partitions(spark):
    rng = random.Random(10)
    rows = [(i, sentence(rng, 25)) for i in range(500)]
    target = [sentence(rng, 50) for _ in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in ir.importance_ranks(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {r[0]: tuple(r[1:5]) for r in brute_ranks(rows, target)}


def test_resample(spark, empty):
    rng = random.Random(12)
    rows = [(i, sentence(rng, 30), i * 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank long")
    target = spark.createDataFrame([(sentence(rng, 40),)], "text string")
    drawn = ir.resample(df, target)
    assert drawn.columns == df.columns
    want = {r[0] for r in brute_ranks([r[:2] for r in rows], [target.first().text]) if r[4]}
    assert {r.doc_id for r in drawn.collect()} == want and len(want) == 20
    assert ir.importance_ranks(empty, target).count() == 0
    assert ir.importance_ranks(df, target.where("false")).where("rank IS NOT NULL").count() == 20
