"""Session settings and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a temporary one, for local sessions only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        set_dir = context._jsc.sc().getCheckpointDir()
        folder = set_dir.get() if set_dir.isDefined() else getattr(context, "_lodestone_dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = context._lodestone_dir = tempfile.mkdtemp(prefix="lodestone-")
    return folder


#: Folders that materialize() has written inside the innermost scratch(); each thread and each task of an event loop has its own.
_inside: ContextVar[list[str] | None] = ContextVar("_inside", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialized inside go at the end, also of a block that fails, but for those given to the function that this returns: these belong to the scratch() around it, or to the caller."""
    written: list[str] = []
    kept: set[str] = set()
    outer = _inside.get()
    token = _inside.set(written)
    try:
        yield lambda df: kept.update(_folders(df))
    finally:
        _inside.reset(token)
        for path in written:
            if path.rsplit("/", 1)[1] not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of these files, never
    a recomputation of what lies before them. The write is compressed, so it
    takes less room than checkpoint()'s serialized rows.
    """
    path = table_path(df.sparkSession, name)
    written = _inside.get()
    if written is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def remove_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, folder)
