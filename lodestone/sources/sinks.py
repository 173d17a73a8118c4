"""Writers. None of them overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def chunked(df: DataFrame, path: str, rows: int = 500) -> None:
    """Files of at most `rows` records."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def by_key(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder a key; rows meet first, so a key has few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def document(df: DataFrame) -> DataFrame:
    """All columns of each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def report(df: DataFrame, key: str, count: str, most: int = 5) -> DataFrame:
    """One JSON document: the total, and the top entries by count."""
    top = df.orderBy(F.desc(count), key).limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("minus"), F.col(key).alias("key")))).alias("t"))
    total = df.agg(F.sum(count).alias("total"))
    return total.crossJoin(top).select(F.to_json(F.struct("total", F.transform("t", lambda x: F.struct(x["key"].alias("key"), (-x["minus"]).alias("n"))).alias("top"))).alias("json"))
