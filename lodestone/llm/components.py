"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize, remove_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).select(F.col("a").alias("u"), "m")
    return both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    joined = down.join(least, F.col("a") == F.col("u")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (a, b) of longs -> (node, component): each node that is not the smallest of its component, and that smallest one.

    Every step is written to the shared folder, the one before it deleted; nothing is collected but a count and a checksum.
    Edges with nulls and from a node to itself count for nothing.
    """
    spark = edges.sparkSession
    given = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL"), name)
    now = materialize(_small_star(given), name)
    remove_table(spark, given)
    sign = None
    while True:
        new_sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new_sign == sign or not new_sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        sign, old = new_sign, now
        now = materialize(_small_star(_large_star(old)), name)
        remove_table(spark, old)
