"""Metrics over streams of judgement events (an extension: batch programs have no streams).

Events come with a timestamp without zone; it is cast before the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def judged(events: DataFrame) -> DataFrame:
    """Events as verdicts: session (user), case, protocol, expected and found state, ts."""
    k = F.get_json_object("props", "$.k").cast("int")
    states = F.array(*map(F.lit, "OCLN"))
    return events.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("case"),
        F.col("event_type").alias("protocol"),
        F.get(states, F.pmod(F.floor("value").cast("int"), F.lit(4))).alias("state"),
        F.when(k % 5 != 0, F.get(states, F.pmod(k, F.lit(4)))).alias("expected"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def windowed_index(verdicts: DataFrame, window: Column | None = None, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Bond index by window (an hour by default) and protocol; rows that come later than `late` are left out."""
    keys = ["protocol"] if keys is None else keys
    window = F.window("ts", "1 hour") if window is None else window
    miss = F.sum(F.when(F.col("expected").isNotNull() & (F.col("state") != F.col("expected")), 1).otherwise(0))
    out = verdicts.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), miss.alias("defects"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "defects", (F.col("defects") / F.col("n")).alias("bond_index"))


def session_index(verdicts: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return windowed_index(verdicts, F.session_window("ts", gap), late, ["session"])


def first_trials(verdicts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each case once, within the watermark."""
    return verdicts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["case"])


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into an in-memory table (for tests)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
