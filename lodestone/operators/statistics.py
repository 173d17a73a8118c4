"""Tests and effect sizes as aggregates; one pass over the table each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import special as D
from lodestone.functions import vectors as V


def two_samples(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: sizes, means and population variances of the values where `first` holds and where it doesn't."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    return df.agg(*[f(x).alias(f"{n}{i}") for i, x in ((1, a), (2, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])


def effect_size(samples: DataFrame) -> DataFrame:
    """Cohen's d, pooled from population variances with weights n - 1; t with sample variances pooled, and its two-sided p; the ratio of the means."""
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    s2 = (n1 * v1 + n2 * v2) / (n1 + n2 - 2)
    out = samples.select("*", ((m1 - m2) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"), ((m1 - m2) / F.nullif(F.sqrt(s2 * (1 / n1 + 1 / n2)), F.lit(0.0))).alias("t"), (m1 / F.nullif(m2, F.lit(0.0))).alias("ratio"))
    return out.withColumn("p", D.t_two_sided(F.col("t"), n1 + n2 - 2))


def running_total(df: DataFrame, order: str, value: Column, name: str, buckets: int = 256) -> DataFrame:
    """The sum of value over all rows before the row, in order of a number; equal numbers must be one row.

    Rows are parted by approximate quantiles; sums run inside a part, and the totals of the parts before are added, so no task sees all rows.
    """
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = df.agg(F.percentile_approx(order, shares).alias("__bounds"))
    parted = df.crossJoin(F.broadcast(bounds)).withColumn("__p", F.size(F.filter("__bounds", lambda b: b < F.col(order)))).drop("__bounds").withColumn("__v", value)
    totals = parted.groupBy("__p").agg(F.sum("__v").alias("__t"))
    # At most as many rows as parts.
    before = totals.select(F.col("__p").alias("__q"), (F.sum("__t").over(W.orderBy("__p")) - F.col("__t")).alias("__before"))
    inside = parted.withColumn("__r", F.sum("__v").over(W.partitionBy("__p").orderBy(order)) - F.col("__v"))
    return inside.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__r") + F.col("__before")).drop("__p", "__q", "__v", "__r", "__before")


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the first sample with average ranks, and the one-sided p (greater) by the normal approximation with ties.

    Ranks come from counts by value, so equal values meet in one row; the running sum goes over distinct values.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    run = running_total(by, value, F.col("a") + F.col("b"), "before")
    t = F.col("a") + F.col("b")
    rank = F.col("before") + (t + 1) / 2
    out = run.agg(F.sum(F.col("a") * rank).alias("r1"), F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return out.select("n1", "n2", u.alias("u"), D.normal_greater((u - n1 * n2 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))).alias("p_greater"))


def one_proportion(k: Column, n: Column, chance: float) -> tuple[Column, Column, Column]:
    """z, one-sided p, and Cohen's h against a chance level."""
    p = k / n
    z = (p - chance) / F.sqrt(F.lit(chance * (1 - chance)) / n)
    return z, D.normal_greater(z), 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(F.lit(chance)))


def two_proportions(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """z and two-sided p of a gap."""
    pooled = (k1 + k2) / (n1 + n2)
    z = (k1 / n1 - k2 / n2) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return z, 2 * D.normal_greater(F.abs(z))


def _resampled(resamples: int, seed: int):
    """For each task and resample: the sum of weights, and of weighted values. A weight is Poisson with mean 1, by a hash of the row's key and the resample."""
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    step = np.uint64(0x9E3779B97F4A7C15)
    draws = (np.arange(1, resamples + 1, dtype=np.uint64) + np.uint64(seed)) * step

    def run(batches) -> Iterator[pa.RecordBatch]:
        weights, sums = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            keys, values = batch.column(0).to_numpy().astype(np.int64).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for begin in range(0, len(keys), 2048):
                h = keys[begin : begin + 2048, None] ^ draws[None]
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
                k = np.searchsorted(cumulative, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53), "right")
                weights += k.sum(0)
                sums += values[begin : begin + 2048] @ k
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weights), pa.array(sums)], ["b", "k", "s"])

    return run


def bootstrap(df: DataFrame, value: str, id_col: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of the mean.

    A resample draws each row as often as a Poisson variable of mean 1 says (by a hash of row and resample), so rows need no
    numbers and nothing is collected: each task adds up all resamples of its rows, and gives a row each. The interval is that of bootstrap means; fewer than two rows give the mean three times.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(id_col, value).alias("key"), F.col(value).cast("double").alias("value"))
    sums = rows.mapInArrow(_resampled(resamples, seed), "b bigint, k double, s double")
    means = sums.groupBy("b").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0.0))).alias("m"))
    low, high = (1 - level) / 2, (1 + level) / 2
    interval = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    mean = df.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return mean.crossJoin(interval).select("n", "mean", F.when(F.col("n") < 2, F.col("mean")).otherwise(F.col("low")).alias("low"), F.when(F.col("n") < 2, F.col("mean")).otherwise(F.col("high")).alias("high"))


def verdict(ratio: Column, p: Column, d: Column, n: Column) -> Column:
    """How well a ratio of effects is supported; limits are stricter with 30 samples, looser with fewer than 15."""

    def by_size(large: float, medium: float, small: float) -> Column:
        return F.when(n >= 30, large).when(n >= 15, medium).otherwise(small)

    strong = (ratio >= by_size(3.0, 2.5, 2.0)) & (p < by_size(0.01, 0.05, 0.10)) & (d > 0.8)
    moderate = (ratio >= by_size(2.0, 1.8, 1.5)) & (p < 0.05) & (d > 0.5)
    weak = (ratio >= by_size(1.5, 1.3, 1.2)) & (p < 0.10)
    return F.when(strong, "STRONG_SUPPORT").when(moderate, "MODERATE_SUPPORT").when(weak, "WEAK_SUPPORT").otherwise("NOT_SUPPORTED")


def split_verdict(transfer: Column, invariant: Column) -> Column:
    """Of one split; invariant is null where it wasn't tested."""
    untested = F.when(transfer, "PARTIAL").otherwise("FAIL")
    return F.when(invariant.isNull(), untested).when(transfer & invariant, "SUCCESS").when(transfer, "LEAK").when(invariant, "WEAK").otherwise("FAIL")


def overall_verdict(verdicts: DataFrame, column: str) -> DataFrame:
    """One row over the verdicts of all splits."""
    n = {v: F.count_if(F.col(column) == v) for v in ("SUCCESS", "LEAK", "PARTIAL")}
    word = F.when(n["SUCCESS"] >= 2, "STRONGLY_SUPPORTED").when(n["SUCCESS"] >= 1, "SUPPORTED").when(n["LEAK"] > 0, "CHALLENGED").when(n["PARTIAL"] >= 2, "PROVISIONAL").otherwise("NOT_SUPPORTED")
    return verdicts.agg(word.alias("overall"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, n, centroid array<double>, spread (mean over dimensions of the population deviation)."""
    long = df.select(label, F.posexplode(vector).alias("dim", "x"))
    by_dim = long.groupBy(label, "dim").agg(F.avg("x").alias("c"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("n"))
    # As many rows a label as there are dimensions.
    out = by_dim.groupBy(label).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("cs"), F.avg("s").alias("spread"))
    return out.select(label, "n", F.transform("cs", lambda x: x["c"]).alias("centroid"), "spread")


def nearest(df: DataFrame, vector: str, id_col: str, table: DataFrame, label: str, exclude: Column | None = None) -> DataFrame:
    """id, nearest label and its cosine distance; null where no label is left. The table holds one row a label (bounded by the number of labels).

    All labels travel as one array, so a row is compared where it is read: nothing is multiplied and nothing shuffled.
    """
    one = table.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid").alias("c"))).alias("__all"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("__v"), (F.lit(None) if exclude is None else exclude).alias("__x")).crossJoin(F.broadcast(one))
    others = F.col("__all") if exclude is None else F.filter("__all", lambda e: e["label"] != F.col("__x"))
    best = F.array_min(F.transform(others, lambda e: F.struct(V.cosine_distance(F.col("__v"), e["c"]).alias("d"), e["label"].alias("label"))))
    return rows.select("id", best.alias("__b")).select("id", F.col("__b.label").alias("label"), F.col("__b.d").alias("distance"))


def extreme_labels(table: DataFrame, label: str, components: list[list[float]], most: int = 2) -> DataFrame:
    """The labels whose centroids project lowest and highest on each component: component (from 1), side, place (from 1), label, projection.

    The table holds one row a label; equal projections are ordered by label, and fewer than `most` labels give as many rows as there are.
    """
    axes = F.array(*[F.array(*map(F.lit, c)) for c in components])
    rows = table.select(F.col(label).alias("label"), F.posexplode(F.transform(axes, lambda c: V.dot(F.col("centroid"), c))).alias("at", "projection"))
    rows = rows.select((F.col("at") + 1).alias("component"), "label", "projection")
    sides = []
    for side, order in (("low", F.col("projection").asc()), ("high", F.col("projection").desc())):
        place = F.row_number().over(W.partitionBy("component").orderBy(order, "label"))
        sides.append(rows.select("component", F.lit(side).alias("side"), place.alias("place"), "label", "projection").where(F.col("place") <= most))
    return sides[0].unionByName(sides[1])


#: Labels whose pairs are measured, at most.
MOST_LABELS = 10_000


def centroid_distances(table: DataFrame, label: str) -> DataFrame:
    """All pairs of labels: a, b, cosine distance, L2 distance. Tables of more than MOST_LABELS labels are an error: their pairs would not stay few."""
    n = table.count()
    if n > MOST_LABELS:
        raise ValueError(f"{n} labels: {MOST_LABELS} at most")
    a = table.select(F.col(label).alias("a"), F.col("centroid").alias("__a"))
    b = table.select(F.col(label).alias("b"), F.col("centroid").alias("__b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", V.cosine_distance(F.col("__a"), F.col("__b")).alias("cosine_distance"), V.distance(F.col("__a"), F.col("__b")).alias("l2"))


def variance_shares(df: DataFrame, first: str, second: str, vector: str, dimensions: int) -> DataFrame:
    """factor, degrees, squares, eta_squared of vectors by two crossed factors: each factor, their interaction, within and total.

    One pass sums each component by cell (a row a pair of values); all else comes from these sums. Squares of a factor are those between its means; interaction is what the cells add to both, which
    may be below zero where the cells are of unequal size. Rows with a null vector, or one of another length, are left out; null values of a factor are a value.
    """
    x = lambda i: F.get(vector, F.lit(i)).cast("double")
    sums = F.array(*[F.sum(x(i)) for i in range(dimensions)])
    square = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    cells = df.where(F.size(vector) == dimensions).groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"), F.sum(square).alias("q"))
    long = cells.select("a", "b", "n", "q", F.posexplode("sums").alias("i", "s"))

    def between(keys: list[str]) -> DataFrame:
        """The sum over groups of the squared norms of their sums, each over its number of rows; the number of groups; the sum of squares of all rows."""
        by = long.groupBy(*keys, "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q"))
        return by.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m"), F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("k"), F.sum(F.when(F.col("i") == 0, F.col("q"))).alias("q"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"))

    names = {"first": ["a"], "second": ["b"], "cells": ["a", "b"], "all": []}
    # One row each.
    row = None
    for name, keys in names.items():
        one = between(keys).select(*[F.col(c).alias(f"{name}_{c}") for c in ("m", "k", "q", "n")])
        row = one if row is None else row.join(F.broadcast(one), F.lit(True))
    m = {n: F.col(f"{n}_m") - F.col("all_m") for n in names}
    k = {n: F.col(f"{n}_k") - 1 for n in names}
    total = F.col("all_q") - F.col("all_m")
    lines = [("first", k["first"], m["first"]), ("second", k["second"], m["second"]), ("interaction", k["cells"] - k["first"] - k["second"], m["cells"] - m["first"] - m["second"]), ("within", F.col("all_n") - F.col("cells_k"), total - m["cells"]), ("total", F.col("all_n") - 1, total)]
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), d.cast("long").alias("degrees"), s.alias("squares"), (s / F.nullif(total, F.lit(0.0))).alias("eta_squared")) for n, d, s in lines])
    return row.select(F.explode(rows).alias("r")).select("r.*").where(F.col("squares").isNotNull())
