"""Readers: files that Spark lists and parses, with explicit schemas; nothing is fetched over a network from executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT = "struct<party_name:string,state:string,expected:string>"
TRIALS = (
    "trial_id string, session_id string, letter_id string, day int, week int, protocol string, protocol_params map<string,string>, "
    f"verdicts array<{VERDICT}>, time_reading_ms int, time_responding_ms int, editor_mood string, career_stage string, timestamp timestamp"
)
RESULTS = (
    "simulation_id string, letter_id string, model string, protocol string, verdicts array<struct<party_name:string,classification:string,expected:string,"
    "is_correct:boolean,confidence:double,primary_dimension:string,reasoning:string>>, advice string, ethical_dimensions map<string,double>, latency_ms double, timestamp timestamp, error string"
)
PASSAGES = (
    "id string, text_original string, text_english string, time_period string, century int, source string, source_type string, category string, language string, "
    "word_count int, has_dispute boolean, consensus_tier string, bond_types array<string>"
)
LEXICON = "language string, kind string, class string, ordinal int, pattern string"


def json_lines(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """One record a line; blank lines are skipped, broken ones have nulls and their text in _corrupt."""
    fields = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    return spark.read.schema(fields).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).json(path)


def json_documents(spark: SparkSession, path: str, item: str, key: str = "letters") -> DataFrame:
    """Files that hold a list of items, or an object with such a list under a key."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<{item}>")
    as_object = F.from_json("value", f"{key} array<{item}>")[key]
    return text.select(F.explode(F.when(F.ltrim(F.col("value")).startswith("["), as_list).otherwise(as_object)).alias("item")).select("item.*")


def csv_any(spark: SparkSession, path: str, names: dict[str, list[str]], mode: str = "PERMISSIVE", sep: str = ",") -> DataFrame:
    """A CSV file with a header; each column is the first of its candidates that is there (null if none is)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", mode).option("sep", sep).option("maxCharsPerColumn", -1).csv(path)
    there = {c.lower(): c for c in df.columns}

    def pick(candidates: list[str]) -> Column:
        found = next((there[c.lower()] for c in candidates if c.lower() in there), None)
        return F.col(f"`{found}`") if found else F.lit(None).cast("string")

    return df.select(*[pick(cs).alias(n) for n, cs in names.items()])


def delimited(spark: SparkSession, path: str, names: list[str], sep: str = "|") -> DataFrame:
    """Lines of fields without a header or quotes; the last field takes the rest."""
    parts = F.split("value", f"[{sep}]", len(names))
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def tree(spark: SparkSession, path: str, glob: str = "*.json", prefer: str = "merged.json", category: str | None = None) -> DataFrame:
    """Whole files below a folder: path, category (first part), source (last folder), value. Of a folder, the preferred file if it is there."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    full = F.col("_metadata.file_path")
    parts = F.split(F.regexp_replace(full, f"^.*?{path.rstrip('/').split('/')[-1]}/", ""), "/")
    df = df.select(full.alias("path"), F.get(parts, F.lit(0)).alias("category"), F.element_at(F.concat(F.array(F.lit("")), parts), -2).alias("source"), F.col("_metadata.file_name").alias("file"), "value")
    if category:
        df = df.where(F.contains(F.lower("path"), F.lit(category.lower())))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    best = df.select(folder.alias("f"), "file").groupBy("f").agg(F.max(F.col("file") == prefer).alias("has"))
    return df.join(best, folder == F.col("f")).where(~F.col("has") | (F.col("file") == prefer)).drop("f", "has", "file")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: path, ordinal (from 1, in the file), value. Files are read whole, so they should be small."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("ordinal", "value")).withColumn("ordinal", F.col("ordinal") + 1)


def tar_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Text members of TAR files whose name ends in a suffix: path, member, value."""

    def run(batches) -> Iterator:
        import io
        import tarfile

        import pandas as pd

        for batch in batches:
            for r in batch.itertuples(index=False):
                with tarfile.open(fileobj=io.BytesIO(r.content)) as tar:
                    found = [(r.path, m.name, tar.extractfile(m).read().decode(errors="replace")) for m in tar if m.isfile() and m.name.endswith(suffix)]
                yield pd.DataFrame(found, columns=["path", "member", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, value string")


def segments(text: Column, tag: str = "seg") -> Column:
    """Contents of the elements of a name, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)


def stripped_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def chapters(df: DataFrame, answer: str, period: str, longer_than: int = 10) -> DataFrame:
    """Landed answers of a chapter service (JSON texts with an array "fulltext"): by period, how many couldn't be read, and how many of the texts in the others are longer than a few characters."""
    found = F.from_json(answer, "fulltext array<string>")["fulltext"]
    texts = F.size(F.filter(found, lambda x: F.char_length(x) > longer_than))
    return df.groupBy(period).agg(F.count_if(found.isNull()).alias("failures"), F.coalesce(F.sum(F.when(found.isNotNull(), texts)), F.lit(0)).cast("long").alias("texts"))


def numbered(df: DataFrame, map_col: str) -> DataFrame:
    """Entries of a map with numbers as keys, in their order: number, value."""
    return df.select(F.explode(map_col).alias("k", "value")).select(F.col("k").try_cast("int").alias("number"), "value").where(F.col("number").isNotNull()).orderBy("number")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_lexicon(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """A lexicon table (JSON lines of LEXICON) as language -> class -> patterns, in order; a lexicon is a program, not data, and is small."""
    out: dict[str, dict[str, list[str]]] = {}
    for r in spark.read.schema(LEXICON).json(path).orderBy("language", "ordinal").collect():
        out.setdefault(r["language"], {}).setdefault(r["class"], []).append(r["pattern"])
    return out


def read_yaml(spark: SparkSession, path: str, schema: str, key: str = "letters", required: tuple[str, ...] = (), errors: bool = False, glob: str = "*") -> DataFrame:
    """Items of YAML files (a list, or one under a key), a task a group of files: the columns of the schema.

    An item that isn't a mapping or lacks a required field, and a file that can't be parsed, are left out; with errors, they are rows of nulls with a reason in the columns _file and _error, and the others
    have nulls there. Fields that the schema doesn't name are left out; those that don't fit their type are null.
    """

    def run(batches) -> Iterator:
        import pandas as pd

        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML takes PyYAML, which is not installed") from e
        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["value"], strict=True):
                try:
                    found = yaml.safe_load(text) or []
                except yaml.YAMLError:
                    out.append((file, None, "not YAML"))
                    continue
                items = found.get(key, []) if isinstance(found, dict) else found
                for i, x in enumerate(items if isinstance(items, list) else [items], 1):
                    lacks = [r for r in required if x.get(r) is None] if isinstance(x, dict) else []
                    reason = f"item {i} is no mapping" if not isinstance(x, dict) else f"item {i} lacks {', '.join(lacks)}" if lacks else None
                    out.append((file, None if reason else json.dumps(x, default=str), reason))
            yield pd.DataFrame(out, columns=["file", "item", "error"])

    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = text.select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(run, "file string, item string, error string")
    rows = rows.select(F.from_json("item", schema).alias("x"), F.when(F.col("error").isNotNull(), F.col("file")).alias("_file"), F.col("error").alias("_error"))
    return rows.select("x.*", "_file", "_error") if errors else rows.where("_error IS NULL").select("x.*")


def snapshot(spark: SparkSession, path: str, build, columns: list[str]) -> DataFrame:
    """The Parquet table at a path if it is there and has these columns, else what build() gives, written there."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        df = spark.read.parquet(path)
        if set(columns) <= set(df.columns):
            return df
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def passages(docs: DataFrame) -> DataFrame:
    """The documents table in the form of passages: id, text, language, source, time_period, time_periods, century."""
    from lodestone.functions import lexicons as L

    number = F.coalesce(F.nullif(F.regexp_extract("source", r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    period = F.get(F.array(*map(F.lit, L.PERIODS)), (number % len(L.PERIODS)).cast("int"))
    century = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.CENTURIES.items() for x in kv]), period), F.lit(0))
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), "source", period.alias("time_period"), F.array(period).alias("time_periods"), century.alias("century"))
