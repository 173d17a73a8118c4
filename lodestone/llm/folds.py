"""Labelled samples and folds of the classifiers."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import byte_arrays as ba

#: Folds by CRC-32 of the id as text; the held-out one.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


#: Bytes of a text that is fitted on: the sample is one task's, so its size has a bound too.
MOST_BYTES = 1 << 17


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """text, y, place: at most `rows` labelled rows outside the held-out fold, the first in order of a hash of the id; those with a longer text than most_bytes are not in the sample (they are scored like all others).

    The bound holds for what is broadcast (ids and labels) and for the sample. Rows without a label or an id
    are left out; ids with contradicting labels count as their smallest one.
    """
    chosen = labels.select(F.col("doc_id").alias("i"), F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    chosen = chosen.groupBy("i").agg(F.min("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("i"))
    place = F.struct(F.xxhash64("i").alias("a"), F.col("i").cast("string").alias("b"), F.xxhash64("text").alias("c"))
    return found.where(F.octet_length("text") <= most_bytes).select("text", F.col("y").cast("int").alias("y"), place.alias("place")).orderBy("place").limit(rows)


def fitted(sample: DataFrame, fit):
    """fit(texts, labels) of a bounded sample, run in one task, so that the driver sees the model only."""

    def run(batches):
        rows = sorted((p["a"], p["b"], p["c"], x, y) for b in batches for x, y, p in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = fit([r[3] for r in rows], [r[4] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(ba.trimmed(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], [])
