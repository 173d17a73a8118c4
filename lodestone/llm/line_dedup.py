"""Line deduplication (operator 4): native Spark expressions only.

A line is known by a 128-bit hash (two 64-bit ones) of its key. Counting with map-side combining leaves the hashes that may be
frequent enough; only their lines go on, without text. They are range-partitioned by hash, a heavy hash in SALTS parts by document, with a secondary sort by document
and position, and stream past: the first occurrence in each document counts the documents, the very first one is the
least of those of the parts. Per document the dropped positions become a keep bitmap, compressed to run lengths, and the text is touched
again only where the bitmap is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that a key loses at both ends.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a hash, by document.
SALTS = 16


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else; texts that are all ASCII take the faster way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(lower_ascii(text), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _row_key(id_col: Column, text: Column) -> list[Column]:
    """128 bits for a row: rows that share an id, or have none, are told apart by their texts."""
    return [F.xxhash64(id_col, text).alias("r1"), F.xxhash64(F.lit(1), id_col, text).alias("r2")]


def _runs(dropped: Column) -> tuple[Column, Column]:
    """First and last positions of the runs of an ascending array of positions."""
    firsts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    lasts = F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1))
    return firsts, lasts


def _before(firsts: Column, lasts: Column, i: Column) -> Column:
    """Where the kept run before run i begins."""
    return F.when(i == 0, F.lit(0)).otherwise(F.get(lasts, i - 1) + 1)


def line_bitmaps(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "all", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Per row that loses lines: r1 and r2 (its key, see _row_key), firsts and lasts (ascending positions where runs of dropped lines begin and end).

    mode "all": keys found in min_docs documents at least lose all their lines.
    mode "first": of the lines with such a key, the first in order of document and position stays; with min_docs=1, repeats inside one document count too.
    Rows that share an id are one document; rows without an id come first, and each text of theirs is one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(F.col(id_col).alias("doc_id"), *_row_key(F.col(id_col), text), line_keys(text).alias("keys"))
    keys = keys.withColumn("d", F.when(F.col("doc_id").isNull(), F.col("r1")).otherwise(F.xxhash64("doc_id")))
    lines = keys.select("doc_id", "d", "r1", "r2", F.posexplode("keys").alias("pos", "key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("doc_id", "d", "r1", "r2", "pos", *_hashes(F.col("key")), F.pmod("d", F.lit(SALTS)).alias("s"))
    least = max(min_docs, 1)
    one_document = mode == "first" and min_docs < 2
    counted = keys.select(F.explode("keys" if one_document else F.array_distinct("keys")).alias("key")).where(F.char_length("key") >= min_chars).select(*_hashes(F.col("key")))
    maybe = counted.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (2 if one_document else least))
    hits = lines.join(_salted(maybe.select("h1", "h2")), ["h1", "h2", "s"], "left_semi")
    ranges = hits.repartitionByRange("h1", "h2", "s")
    stream = Window.partitionBy("h1", "h2", "s").orderBy("doc_id", "d", "pos")
    place = F.struct("doc_id", "d", "pos")
    ranges = ranges.withColumn("new", ~F.lag("d").over(stream).eqNullSafe(F.col("d")))
    verdicts = ranges.where("new").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= least)
    dropped = ranges.join(_salted(verdicts.select("h1", "h2", "first")), ["h1", "h2", "s"])
    if mode == "first":
        dropped = dropped.where(~place.eqNullSafe(F.col("first")))
    drops = dropped.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    firsts, lasts = _runs(F.col("pos"))
    return drops.select("r1", "r2", firsts.alias("firsts"), lasts.alias("lasts"))


def _salted(hashes: DataFrame) -> DataFrame:
    """Each row once for each part; these are the frequent hashes only."""
    return hashes.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "all", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """One row per input row: the columns of df with the text cleaned, and n_lines, n_dropped, keep_runs (array<long>).

    keep_runs is the keep bitmap in run lengths: so many lines stay, so many go, and so on.
    Null and empty texts are one empty line, and stay so (a null stays null). Keys shorter than min_chars
    code points are never dropped. Rows that share an id are one document, but each is cleaned by its own lines; a row without an id
    is a document named by its text. Rows that are equal fare alike. Very long texts are lines like others; positions are int. An empty table gives no rows.
    Columns of df named like the three new ones are replaced.
    """
    new = ["n_lines", "n_dropped", "keep_runs"]
    bitmaps = line_bitmaps(df, id_col, text_col, mode, min_docs, min_chars).select(F.col("r1").alias("__b1"), F.col("r2").alias("__b2"), F.col("firsts").alias("__firsts"), F.col("lasts").alias("__lasts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    r1, r2 = _row_key(F.col(id_col), text)
    out = df.drop(*new).withColumns({"__r1": r1, "__r2": r2}).join(bitmaps, (F.col("__r1") == F.col("__b1")) & (F.col("__r2") == F.col("__b2")), "left")
    out = out.withColumn("__lines", F.split(text, "\n"))
    firsts, lasts, n = F.col("__firsts"), F.col("__lasts"), F.size("__lines").cast("long")
    some = firsts.isNotNull()
    inner = F.flatten(F.transform(firsts, lambda p, i: F.array(p - _before(firsts, lasts, i), F.get(lasts, i) - p + 1))).cast("array<long>")
    tail = n - F.element_at(lasts, -1) - 1
    runs = F.when(some, F.concat(inner, F.when(tail > 0, F.array(tail)).otherwise(F.array().cast("array<long>")))).otherwise(F.array(n))
    kept = F.flatten(F.transform(firsts, lambda p, i: F.slice("__lines", _before(firsts, lasts, i) + 1, p - _before(firsts, lasts, i))))
    kept = F.concat(kept, F.slice("__lines", F.element_at(lasts, -1) + 2, F.size("__lines")))
    gone = F.aggregate(F.zip_with(firsts, lasts, lambda a, b: b - a + 1), F.lit(0), lambda a, x: a + x)
    out = out.withColumns({"keep_runs": runs, "n_lines": n, "n_dropped": F.coalesce(gone, F.lit(0)).cast("long"), text_col: F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text_col))})
    return out.select(*[c for c in df.columns if c not in new], *new)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs, mode="all", min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.array_join("keep_runs", ",").alias("keep_runs"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), bad AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, b.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN bad b ON k.key = b.key
)
SELECT d.*, r.keep_runs FROM (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
) d JOIN (
  SELECT doc_id, CASE WHEN bool_or(run = 1 AND dropped) THEN '0,' ELSE '' END || string_agg(n, ',' ORDER BY run) AS keep_runs
  FROM (
    SELECT doc_id, run, dropped, count(*)::VARCHAR AS n FROM (
      SELECT doc_id, dropped, sum(change) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
        SELECT doc_id, pos, dropped, CASE WHEN dropped IS DISTINCT FROM lag(dropped) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS change FROM marked
      )
    ) GROUP BY doc_id, run, dropped
  ) GROUP BY doc_id
) r ON d.doc_id = r.doc_id
"""
