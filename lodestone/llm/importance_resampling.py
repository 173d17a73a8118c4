"""Target-distribution importance resampling (operator 13): native Spark expressions only.

A text's features are its words and pairs of neighbouring words, hashed into buckets (CRC-32 modulo their number). Exploded arrays of them are counted by bucket,
over the corpus and over the target; a bucket's gain is the logarithm of how much likelier the target makes it. The table of gains has one row a bucket, whatever the
input, and is broadcast; exploded again, the features of a document meet it, and their gains are averaged: its weight. With a Gumbel number drawn from
the id's hash, the highest scores are a sample without replacement in proportion to exp(weight / 1000).

Scores are range-partitioned and written with the number of their partition; a rank is what lies in the partitions before, and the place in its own. Partitions
that begin beyond the last rank drawn aren't sorted at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.line_dedup import lower_ascii
from lodestone.session import materialize

#: The parameters of the contract.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: What isn't part of a word, once A-Z is lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of a-z (A-Z lower-cased), digits and characters beyond ASCII; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def ngrams(words: Column) -> Column:
    """The words, and each two neighbours joined by a space."""
    pairs = F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.concat(words, pairs)


def bucket_counts(df: DataFrame, text_col: str, buckets: int, count: str) -> DataFrame:
    """bucket, and how many features of all texts fall into it."""
    words = df.select(words_of(F.col(text_col)).alias("__w"))
    found = words.select(F.explode(ngrams(F.col("__w"))).alias("f")).select((F.crc32("f") % buckets).alias("bucket"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias(count))


def gains(df: DataFrame, target: DataFrame, text_col: str, target_col: str, buckets: int) -> DataFrame:
    """bucket, gain: a row for each bucket."""
    spark = df.sparkSession
    out = spark.range(buckets).select(F.col("id").alias("bucket"))
    for table, col, n in ((df, text_col, "s"), (target, target_col, "t")):
        out = out.join(bucket_counts(table, col, buckets, n), "bucket", "left")
    out = out.select("bucket", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in "st"])
    whole = out.agg((F.sum("s") + buckets).alias("all_s"), (F.sum("t") + buckets).alias("all_t"))
    likelier = (F.col("t") + 1) * F.col("all_s") / ((F.col("s") + 1) * F.col("all_t"))
    return out.join(F.broadcast(whole), F.lit(True)).select(F.col("bucket"), F.floor(F.lit(1000.0) * F.log(likelier)).cast("long").alias("gain"))


def _key(id_col: str, text_col: str) -> list[Column]:
    """128 bits for a row: rows that share an id are told apart by their texts."""
    return [F.xxhash64(F.lit(k), id_col, text_col).alias(f"k{k}") for k in (1, 2)]


def _scored(df: DataFrame, table: DataFrame, id_col: str, text_col: str, buckets: int, seed: int) -> DataFrame:
    """doc_id, k1, k2, copies (rows that are equal in both), n_words, n_features, weight, score."""
    rows = df.select(F.col(id_col).alias("doc_id"), *_key(id_col, text_col), words_of(F.col(text_col)).alias("__w"))
    rows = rows.select("doc_id", "k1", "k2", F.size("__w").cast("long").alias("n_words"), ngrams(F.col("__w")).alias("f"))
    # One null a row: documents without features stay, and copies are counted.
    found = rows.select("doc_id", "k1", "k2", "n_words", F.explode(F.concat(F.array(F.lit(None).cast("string")), "f")).alias("f"))
    found = found.select("doc_id", "k1", "k2", "n_words", (F.crc32("f") % buckets).alias("bucket")).join(F.broadcast(table), "bucket", "left")
    docs = found.groupBy("doc_id", "k1", "k2", "n_words").agg(F.count(F.lit(1)).alias("all"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    docs = docs.withColumn("copies", F.col("all") - F.col("n"))
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) DIV n")).otherwise(0).cast("long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    docs = docs.select("doc_id", "k1", "k2", "copies", "n_words", F.expr("n DIV copies").alias("n_features"), weight.alias("weight"), gumbel.alias("g"))
    return docs.select("doc_id", "k1", "k2", "copies", "n_words", "n_features", "weight", (F.col("weight") + F.col("g")).alias("score"))


def _ranked(df: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, buckets: int, least_words: int, percent: int, seed: int, name: str) -> DataFrame:
    """What _scored has, one row per input row, and rank."""
    table = materialize(gains(df, target, text_col, target_col, buckets), f"{name}-gains")
    scored = materialize(_scored(df, table, id_col, text_col, buckets, seed), f"{name}-scores")
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("k1"), F.col("k2")]
    ranges = materialize(scored.where(able).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = ranges.groupBy("part").agg(F.sum("copies").alias("n"))
    # A row a partition.
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.floor(F.sum("n").over(every) * percent / 100).cast("long").alias("most"))
    placed = ranges.join(F.broadcast(parts), "part")
    in_part = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = placed.where("offset < most").withColumn("first", F.col("offset") + F.coalesce(F.sum("copies").over(in_part), F.lit(0)))
    rank = F.col("first") + F.col("i")
    columns = [*scored.columns]
    drawn = first.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns, F.when(rank <= F.col("most"), rank).alias("rank"))
    rest = scored.where(~able).unionByName(placed.where("offset >= most").select(*columns))
    rest = rest.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def importance_ranks(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, name: str = "resampling"
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (null where it isn't drawn), all but doc_id long.

    Of the rows with least_words words, percent of a hundred are drawn, by score, then by id. Null and empty texts have no feature, weight 0 and no rank. Rows
    without an id draw by the name "null" and come last among equals; rows that share an id draw alike, and those that share their text too have
    ranks one after the other. Texts of any length are read whole (their features are held at once). Other columns are ignored, whatever their names. An empty table gives no
    rows; an empty target makes rare features the likelier ones.
    """
    return _ranked(df, target, id_col, text_col, target_col, buckets, least_words, percent, seed, name).select("doc_id", "n_features", "weight", "score", "rank")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", name: str = "resampling", **options) -> DataFrame:
    """The rows of df that importance_ranks draws, with all their columns; of rows that are equal in id and text, all go where one is drawn."""
    o = {"buckets": BUCKETS, "least_words": LEAST_WORDS, "percent": PERCENT, "seed": SEED} | options
    drawn = _ranked(df, target, id_col, text_col, target_col, name=name, **o).where("rank IS NOT NULL").select(F.col("k1").alias("__a"), F.col("k2").alias("__b")).distinct()
    k1, k2 = _key(id_col, text_col)
    return df.withColumns({"__k1": k1, "__k2": k2}).join(drawn, (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b")), "left_semi").select(*df.columns)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 is spelled out: its table of 256 numbers by rule, then one step a byte.
OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_features AS (
  SELECT doc_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM docs
), item_features AS (
  SELECT unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM items
), bytes AS (
  SELECT f, list_transform(range(1, len(hex(f)) // 2 + 1), lambda i: ('0x' || hex(f)[2 * i - 1:2 * i])::BIGINT) AS b
  FROM (SELECT f FROM doc_features UNION SELECT f FROM item_features)
), buckets AS (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), s AS (
  SELECT bucket, count(*) AS n FROM doc_features JOIN buckets USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM item_features JOIN buckets USING (f) GROUP BY bucket
), gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT sum(n) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket
), weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM doc_features JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT docs.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || docs.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights ON docs.doc_id = weights.doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scores WHERE n_words >= 20
)
SELECT scores.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank
FROM scores LEFT JOIN placed ON scores.doc_id = placed.doc_id
"""
