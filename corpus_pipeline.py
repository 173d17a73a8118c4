"""A training-data pipeline over the documents table: five operators, each stage written as Parquet and read again.

Edges, for all stages: null texts count as empty and stay null; empty texts stay rows; texts of any length are read whole; an empty table
gives an empty one; columns other than doc_id and text are passed through, whatever their names (n_chars follows the text). Rows with
equal ids or equal to each other stay as many as they are, but where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, line_dedup, packing, suffix_dedup, toxicity
from lodestone.session import materialize, remove_table, scratch


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.3 or more) go; null and empty texts are scored as empty ones."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that ten documents have, the first occurrence (by doc_id and position) stays, so that of many copies of a document one stays whole.

    A text whose lines all go is empty. Lines of white space alone stay.
    """
    out = line_dedup.line_dedup(docs, mode="first", min_docs=10)
    return _with_length(out.select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id, stays: five words, similarity 0.8. Documents without words, and rows without an id, all stay."""
    return jaccard_join.drop_near_duplicates(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a repeated string of 200 bytes covers go, all copies alike; of a character that loses bytes, the others go too."""
    return _with_length(suffix_dedup.suffix_dedup(docs, width=200))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, one row for each piece of a document; empty texts have the closing id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: The classifier, the repeats and the packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself goes when its own table is written, and so does the table before it. The last table that was kept, and those of packing, are the caller's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            now = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(now)
        if before is not None:
            remove_table(spark, before)
        docs = before = now
    return STAGES[-1][1](spark, docs, sf_dir)
