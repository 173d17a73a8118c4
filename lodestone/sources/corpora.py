"""Corpora by configuration: which of them are enabled, and their union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.splits import global_rank, order_key

COLUMNS = ("corpus", "id", "text", "period")


def enabled(config: dict) -> dict[str, dict]:
    """The corpora of a configuration ({"corpora": {name: {"enabled": ..., ...}}}) that are enabled, in order; one that doesn't say is not."""
    return {name: own for name, own in (config.get("corpora") or {}).items() if own and own.get("enabled", False)}


def union(config: dict, read: Callable[[str], DataFrame]) -> DataFrame:
    """corpus, id, text, period of all enabled corpora.

    Each names its table, the columns of its id and text, and perhaps: category (a column) with periods (value -> period; "UNKNOWN" for others), and max_samples, which keeps so many rows, the first in order of a hash of the id.
    A configuration without an enabled corpus is an error, as there is nothing to take a schema from.
    """
    parts = []
    for name, own in enabled(config).items():
        df = read(own["table"])
        period = F.lit("UNKNOWN")
        for value, p in (own.get("periods") or {}).items():
            period = F.when(F.col(own["category"]) == value, p).otherwise(period)
        df = df.select(F.lit(name).alias("corpus"), F.col(own["id"]).cast("string").alias("id"), F.col(own["text"]).alias("text"), period.alias("period"))
        if own.get("max_samples"):
            df = global_rank(df.withColumn("__k", order_key(F.col("id"))), "__k").where(F.col("rank") <= own["max_samples"]).select(*COLUMNS)
        parts.append(df)
    if not parts:
        raise ValueError("no corpus is enabled")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
