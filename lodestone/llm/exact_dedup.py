"""Exact deduplication (operator 2): native Spark expressions only.

Rows are grouped by a 128-bit hash of their content *and* the content itself:
the hash places the group, the second key makes Spark compare the bytes inside
it, so two texts that collide in the hash stay two groups. The grouping
combines on the map side, so copies of one text shrink to one row a task
before the shuffle, however many there are. Texts cross the network once, in that
grouping; the verdict goes back to the rows by digest alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group of equal texts.
    Null texts count as empty ones. Null ids take part, but win only in a group
    whose ids are all null (keep_id is then null). Rows that repeat an id with the same text
    share one verdict: kept is true for each row bearing the winning id.
    An empty table gives no rows; other columns of df are ignored, whatever their names.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("doc_id", "t", F.unhex(F.md5("t")).alias("h"))
    groups = (
        base.groupBy("h", "t")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # A second digest tells apart texts whose first one collides.
        .select(F.col("h").alias("gh"), F.sha2("t", 256).alias("gs"), "keep_id", "group_size")
    )
    rows = base.select("doc_id", "h", F.sha2("t", 256).alias("text_sha256"))
    return rows.join(groups, (F.col("h") == F.col("gh")) & (F.col("text_sha256") == F.col("gs"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
