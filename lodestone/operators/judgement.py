"""Metrics of verdicts: rows of (session, case, party, position, state, expected, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions.dihedral import STATES, correlative


def is_correct(state: Column, expected: Column) -> Column:
    """True, false, or null where nothing is expected."""
    return F.when(expected.isNotNull(), state == expected)


def bond_index(df: DataFrame, keys: list[str], tau: float = 1.0) -> DataFrame:
    """Share of verdicts that miss what is expected, over tau; verdicts without an expectation count in the denominator; 0 without verdicts."""
    miss = F.sum(F.when(~is_correct(F.col("state"), F.col("expected")), 1).otherwise(0))
    index = F.coalesce(miss / F.nullif(F.count(F.lit(1)), F.lit(0)) / tau, F.lit(0.0))
    aggregate = (F.count(F.lit(1)).alias("n"), F.coalesce(miss, F.lit(0)).alias("defects"), index.alias("bond_index"))
    return df.groupBy(*keys).agg(*aggregate)


def accuracy(df: DataFrame, keys: list[str], case: str) -> DataFrame:
    """Right verdicts by trial and by verdict with an expectation."""
    right = F.count_if(is_correct(F.col("state"), F.col("expected")))
    return df.groupBy(*keys).agg(
        F.countDistinct(case).alias("trials"),
        right.alias("correct"),
        (right / F.nullif(F.countDistinct(case), F.lit(0))).alias("accuracy_per_trial"),
        (right / F.nullif(F.count("expected"), F.lit(0))).alias("accuracy_per_verdict"),
    )


def correlative_pairs(df: DataFrame, case: str, position: str) -> DataFrame:
    """Pairs of verdicts of a case, the earlier one being O, C, L or N: case, c1, c2, n. Pairs are counted, not made: a verdict pairs with as many as its state before it in the case."""
    before = W.partitionBy(case).orderBy(position, "state").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.array(*[F.struct(F.lit(x).alias("c1"), F.coalesce(F.sum((F.col("state") == x).cast("long")).over(before), F.lit(0)).alias("n")) for x in STATES])
    rows = df.select(case, F.col("state").alias("c2"), earlier.alias("__e")).select(case, "c2", F.explode("__e").alias("e")).where("e.n > 0")
    return rows.groupBy(case, F.col("e.c1").alias("c1"), "c2").agg(F.sum("e.n").alias("n"))


def correlative_symmetry(pairs: DataFrame) -> DataFrame:
    """One row over pairs (c1, c2, n): pairs and violations by axis (O with C, L with N), their rates of symmetry (1 without pairs), and the share of violations."""
    broken = ~F.col("c2").eqNullSafe(correlative(F.col("c1")))
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    out = pairs.agg(*[number(F.col("c1").isin(*axis) & more).alias(f"{name}_{what}") for name, axis in (("o_c", ("O", "C")), ("l_n", ("L", "N"))) for what, more in (("pairs", F.lit(True)), ("violations", broken))])
    for name in ("o_c", "l_n"):
        out = out.withColumn(f"{name}_rate", F.when(F.col(f"{name}_pairs") > 0, 1 - F.col(f"{name}_violations") / F.col(f"{name}_pairs")).otherwise(1.0))
    total, bad = F.col("o_c_pairs") + F.col("l_n_pairs"), F.col("o_c_violations") + F.col("l_n_violations")
    return out.withColumn("bond_index", F.when(total > 0, bad / total).otherwise(0.0))


def modal_value(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """The most frequent value of each group, the first seen of equals."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("__n"), -F.col("__first"))).alias(name))


def gate_effectiveness(df: DataFrame, least: int = 2) -> DataFrame:
    """Transitions (gate, from, to, ordinal) -> gate, n, modal ends, and the share of transitions that are exactly these; gates whose modal ends are equal are left out."""
    n = df.groupBy("gate").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    ends = modal_value(df, ["gate"], "from", "ordinal", "modal_from").join(modal_value(df, ["gate"], "to", "ordinal", "modal_to"), "gate").where(F.col("modal_from") != F.col("modal_to"))
    out = df.join(ends, "gate").join(n, "gate")
    exact = ((F.col("from") == F.col("modal_from")) & (F.col("to") == F.col("modal_to"))).cast("double")
    return out.groupBy("gate", "n", "modal_from", "modal_to").agg(F.avg(exact).alias("effectiveness"))


def dimension_weights(df: DataFrame, context: list[str], dimension: str = "dimension", value: str = "value") -> DataFrame:
    """Means of present values by context and dimension, and their shares of the context."""
    means = df.where(F.col(value).isNotNull()).groupBy(*context, dimension).agg(F.avg(value).alias("mean"))
    total = F.sum("mean").over(W.partitionBy(*context)) if context else F.sum("mean").over(W.partitionBy(F.lit(1)))
    return means.withColumn("weight", F.col("mean") / F.nullif(total, F.lit(0.0)))


def agreement(df: DataFrame, keys: list[str], high: float = 0.85, low: float = 0.6, least: int = 2) -> DataFrame:
    """Share of the most frequent state in each group of at least `least` votes, and whether it is high or contested."""
    votes = df.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("v"))
    out = votes.groupBy(*keys).agg(F.sum("v").alias("votes"), F.max("v").alias("top")).where(F.col("votes") >= least)
    rate = F.col("top") / F.col("votes")
    return out.select(*keys, "votes", rate.alias("agreement"), F.when(rate >= high, "high").when(rate < low, "contested").otherwise("mixed").alias("level"))


def macro_f1(df: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Mean F1 over all labels that are true or predicted somewhere (0 where undefined), and accuracy."""
    keys = keys or []
    both = df.select(*keys, F.explode(F.array_distinct(F.array(truth, predicted))).alias("label"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    one = both.groupBy(*keys, "label").agg(
        F.count_if((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"),
        F.count_if((F.col("t") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"),
        F.count_if((F.col("t") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"),
    )
    f1 = one.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))
    f1 = f1.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("right"))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = f1.join(n, keys) if keys else f1.crossJoin(n)
    return out.select(*keys, "n", "macro_f1", (F.col("right") / F.col("n")).alias("accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of (true, predicted) and their shares of the true label."""
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("truth")))


def module_summary(df: DataFrame, domain: str, state: str, source: str) -> DataFrame:
    """Per domain: rows, share of each state, and all sources, sorted."""
    shares = [F.avg((F.coalesce(F.col(state), F.lit("")) == s).cast("double")).alias(f"share_{s.lower()}") for s in "OCLN"]
    return df.groupBy(domain).agg(F.count(F.lit(1)).alias("n"), *shares, F.array_sort(F.collect_set(source)).alias("sources"))


def remapped_weights(df: DataFrame, dimension: str, weight: str) -> DataFrame:
    """name, weight: dimensions under the names they are exported with, a missing one at its default, virtue_care at half of SOCIETAL, together 1. Other dimensions are left out."""
    names = df.sparkSession.createDataFrame(list(L.WEIGHT_NAMES.items()), "__d string, name string")
    found = df.groupBy(dimension).agg(F.max(weight).alias("__w"))
    rows = names.join(found, F.col("__d") == F.col(dimension), "left").select("name", F.coalesce("__w", F.lit(L.MISSING_WEIGHT)).alias("weight"))
    care = rows.where(F.col("name") == L.WEIGHT_NAMES["SOCIETAL"]).select(F.lit("virtue_care").alias("name"), (F.col("weight") * 0.5).alias("weight"))
    # Nine rows.
    rows = rows.unionByName(care)
    total = rows.agg(F.sum("weight").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("name", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.col("weight")).alias("weight"))
