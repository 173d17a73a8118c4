"""All queries of the library: name -> function of (spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Which rows of the operator inventory a query covers.
COVERS: dict[str, str] = {}
FLAGSHIP = "rule_distribution"


class Tables:
    """Reads a table by its name; path(name) is where it lies, for readers of streams."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(covers: str, sql: str | None = None):
    """Registers a function of Tables under its name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        COVERS[f.__name__] = covers
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


for _name in ("text_queries", "rule_queries", "relational_queries", "split_queries", "judgement_queries", "vector_queries", "source_queries", "further_queries", "lexicon_queries", "graph_queries", "stream_queries", "inference_queries", "derived_queries", "response_queries"):
    importlib.import_module(f"lodestone.plans.{_name}")
