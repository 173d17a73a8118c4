"""Tables in versions: a rewrite of a table is a new version beside the old one, and becomes the current one in a single step.

A table is a folder with a folder of Parquet files for each version, and a manifest for each that was finished, numbered from 1: a small file that names the version's folder. A writer writes its folder
first; then its manifest is written under another name and renamed to the next number, which fails if another writer has taken it. So a reader sees whole versions only and goes on with the one it began with, a
writer that fails leaves a folder that no manifest names, and of two writers that began from one version the second fails instead of undoing the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class ConflictError(RuntimeError):
    """Another writer has made a version in the meantime."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished versions, in order."""
    at, fs = _fs(spark, f"{path}/{MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _folder(spark: SparkSession, path: str, number: int) -> str:
    (row,) = spark.read.text(f"{path}/{MANIFESTS}/{number:010d}", wholetext=True).collect()
    return f"{path}/{row.value.strip()}"


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version of a table, by default the current one."""
    there = numbers(spark, path)
    if not there or (number is not None and number not in there):
        raise FileNotFoundError(f"{path} has no version {'' if number is None else number}".rstrip())
    return spark.read.parquet(_folder(spark, path, there[-1] if number is None else number))


def write(df: DataFrame, path: str, after: int | None = None) -> int:
    """df as the next version; its number. after: the version that df was made from (0: none), so that a version between the two is a ConflictError; by default the current one."""
    spark = df.sparkSession
    last = numbers(spark, path)
    after = (last[-1] if last else 0) if after is None else after
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    draft, fs = _fs(spark, f"{path}/{MANIFESTS}/.{name}")
    out = fs.create(draft, False)
    out.write(bytearray(name.encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFESTS}/{after + 1:010d}")
    # rename() of a file system may report by its result, and must not replace what is there.
    done = not fs.exists(target) and fs.rename(draft, target)
    if not done:
        for at in (draft, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            fs.delete(at, True)
        raise ConflictError(f"version {after + 1} of {path} is there already")
    return after + 1


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """The current version, changed, as the next one."""
    last = numbers(spark, path)[-1]
    return write(change(read(spark, path, last)), path, after=last)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all but the last versions, and folders that no manifest names; the names of the deleted folders. Not to be run beside a writer, whose folder has no manifest yet."""
    there = numbers(spark, path)
    stay = {_folder(spark, path, n).rsplit("/", 1)[1] for n in there[-keep:]}
    root, fs = _fs(spark, path)
    for n in there[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFESTS}/{n:010d}"), False)
    gone = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in stay]
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return sorted(gone)
