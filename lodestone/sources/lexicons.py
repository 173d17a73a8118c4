"""Lexicons as data: YAML files of patterns by kind, language and class, read into a table.

A file holds `<kind>_patterns: {language: {class: [pattern, ...]}}` for each kind; classes and patterns are in order of precedence. The package ships a file for each
of seven languages; any other file or folder of the same form can be read in their place.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("hebrew", "aramaic", "classical_chinese", "arabic", "english", "sanskrit", "pali")
# The classes of each kind.
KINDS = {
    "bond": ("HARM_PREVENTION", "RECIPROCITY", "AUTONOMY", "PROPERTY", "FAMILY", "AUTHORITY", "CARE", "FAIRNESS", "CONTRACT", "NONE"),
    "hohfeld": ("OBLIGATION", "RIGHT", "LIBERTY", "NO_RIGHT"),
}
SCHEMA = "language string, kind string, class string, class_ordinal int, ordinal int, pattern string"


def _loaded(text: str) -> Iterator[tuple]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML takes PyYAML, which is not installed") from e
    for section, languages in (yaml.safe_load(text) or {}).items():
        if not section.endswith("_patterns"):
            continue
        for language, classes in (languages or {}).items():
            for at, (class_, patterns) in enumerate((classes or {}).items()):
                for i, p in enumerate(patterns or []):
                    yield language, section.removesuffix("_patterns"), class_, at, i, str(p)


def read_lexicons(spark: SparkSession, path: str) -> DataFrame:
    """The patterns of all YAML files under a path, one row each: language, kind, class, class_ordinal, ordinal, pattern. Sections without patterns give no row."""

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([r for text in batch["value"] for r in _loaded(text)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").text(path, wholetext=True)
    return files.mapInPandas(run, SCHEMA)


def shipped(spark: SparkSession, *languages: str) -> DataFrame:
    """The lexicons of the package, of all its languages or of those named, as read_lexicons gives them."""
    rows = [r for n in languages or LANGUAGES for r in _loaded(resources.files("lodestone.lexicons").joinpath(f"{n}.yaml").read_text("utf-8"))]
    return spark.createDataFrame(rows, SCHEMA)


def known(table: DataFrame) -> DataFrame:
    """The patterns whose class is one of its kind; kinds that aren't listed may have any."""
    test = F.lit(True)
    for kind, classes in KINDS.items():
        test &= (F.col("kind") != kind) | F.col("class").isin(*classes)
    return table.where(test)


def unknown(table: DataFrame) -> DataFrame:
    """How many patterns have a class that isn't one of their kind: language, kind, class, n."""
    return table.exceptAll(known(table)).groupBy("language", "kind", "class").agg(F.count(F.lit(1)).alias("n"))


def loaded(table: DataFrame) -> list[tuple[str, str, str, str]]:
    """(language, kind, class, pattern) in order of precedence. A lexicon is a program, not data: it is small, and goes to every task. Unknown classes are left out, with a warning."""
    for r in unknown(table).collect():
        warnings.warn(f"{r['n']} patterns of {r['language']} with the unknown class {r['class']}", stacklevel=2)
    rows = known(table).collect()
    return [(r["language"], r["kind"], r["class"], r["pattern"]) for r in sorted(rows, key=lambda r: (r["language"], r["kind"], r["class_ordinal"], r["ordinal"]))]


def declared(kind: str, lexicon: dict[str, list[str]], language: str = "") -> list[tuple[str, str, str, str]]:
    """A lexicon of lodestone.functions.lexicons in the form of loaded()."""
    return [(language, kind, c, p) for c, ps in lexicon.items() for p in ps]
