"""The dihedral group of order 8 acting on four normative states, by rule instead of by table.

States stand on a circle: O, C, L, N. r turns by one place; s mirrors (O with C, L with N). s r^k mirrors, then turns k places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ["O", "C", "L", "N"]
ELEMENTS = ["e", "r", "r2", "r3", "s", "sr", "sr2", "sr3"]


def _parts(element: Column) -> tuple[Column, Column]:
    at = F.array_position(F.array(*map(F.lit, ELEMENTS)), element) - 1
    return F.floor(at / 4).cast("int"), (at % 4).cast("int")


def _element(mirror: Column, turn: Column) -> Column:
    return F.get(F.array(*map(F.lit, ELEMENTS)), (mirror * 4 + F.pmod(turn, F.lit(4))).cast("int"))


def multiply(a: Column, b: Column) -> Column:
    """a, then b."""
    (ma, ka), (mb, kb) = _parts(a), _parts(b)
    return _element((ma + mb) % 2, F.when(mb == 1, kb - ka).otherwise(ka + kb))


def inverse(a: Column) -> Column:
    m, k = _parts(a)
    return _element(m, F.when(m == 1, k).otherwise(-k))


def act(element: Column, state: Column) -> Column:
    """Where the element takes a state; null for others than the four."""
    m, k = _parts(element)
    x = F.array_position(F.array(*map(F.lit, STATES)), state) - 1
    moved = F.pmod(F.when(m == 1, 1 - x).otherwise(x) + k, F.lit(4)).cast("int")
    return F.when(state.isin(*STATES), F.get(F.array(*map(F.lit, STATES)), moved))


def correlative(state: Column) -> Column:
    return act(F.lit("s"), state)


def compose(path: Column) -> Column:
    """The product of a path (an array of elements), "e" for an empty one."""
    return F.aggregate(path, F.lit("e"), multiply)


def group_table(spark: SparkSession) -> DataFrame:
    """All 64 products."""
    e = spark.createDataFrame([(x,) for x in ELEMENTS], "a string")
    return e.crossJoin(F.broadcast(e.withColumnRenamed("a", "b"))).select("a", "b", multiply(F.col("a"), F.col("b")).alias("product"))


def holonomy(df: DataFrame, session: str, order: list[str], element: str) -> DataFrame:
    """session, steps, element: the product of the elements of each session in order (null elements count as "e").

    Rows are range-partitioned by session and order, so that a long session lies in several partitions, one after the other; each gives a product of its own rows, and the few products of a session are
    multiplied in the order of their partitions.
    """
    rows = df.select(F.col(session).alias("__s"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.coalesce(F.col(element), F.lit("e")).alias("__g"))
    keys = ["__s", *[f"__o{i}" for i in range(len(order))]]
    parts = rows.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    path = F.array_sort(F.collect_list(F.struct(*keys[1:], "__g")))
    parts = parts.groupBy("__s", "__p").agg(path.alias("__path")).select("__s", "__p", F.size("__path").alias("__n"), compose(F.transform("__path", lambda x: x["__g"])).alias("__g"))
    whole = parts.groupBy("__s").agg(F.sum("__n").cast("long").alias("steps"), F.array_sort(F.collect_list(F.struct("__p", "__g"))).alias("__path"))
    return whole.select(F.col("__s").alias(session), "steps", compose(F.transform("__path", lambda x: x["__g"])).alias("element"))


def loops(df: DataFrame, session: str, order: list[str], element: str, state: str) -> DataFrame:
    """session, steps, element, initial, final, matched: whether the product of a session's elements takes its first state to its last one; null where one of these is unknown."""
    place = F.struct(*order)
    ends = df.groupBy(F.col(session).alias("__e")).agg(F.min_by(state, place).alias("initial"), F.max_by(state, place).alias("final"))
    out = holonomy(df, session, order, element).join(ends, F.col(session).eqNullSafe(F.col("__e"))).drop("__e")
    return out.withColumn("matched", act(F.col("element"), F.col("initial")) == F.col("final"))
