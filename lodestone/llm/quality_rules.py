"""Quality rules (operator 11): native Spark expressions only.

Rules see four rates of a text: characters a word, symbols a character, repeated lines a line, words in repeated windows a word. Their
limits aren't fixed: for each language and source, the values of a rate go into a sketch, and a text fails where it lies further outside the
quartiles than FENCE times their distance. A sketch is a histogram whose buckets keep the leading BITS binary digits of a value, so
a quantile is right to one part in 2**(BITS - 1); sketches merge by adding counts, whatever the order, and a sketch has some hundred
buckets however many rows it stands for. Where a source has fewer than LEAST_ROWS texts of a language, the merged sketch of the language
decides, and that of all texts where the language has fewer.

Texts are read once; their counts are written to the shared folder, without text, and the limits are joined to these. A group with more than
a thousandth of all rows is joined by broadcast, as there are at most a thousand of those; the others go through a shuffle in which no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.line_dedup import WHITE
from lodestone.session import materialize

#: The base rules of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Leading binary digits that a bucket keeps.
BITS = 7
#: Distances between the quartiles that a value may lie outside them, and what counts as the least such distance, by rate.
FENCE = 6
RATES = {"word_length": 25, "symbol_rate": 5, "line_rate": 75, "repeat_rate": 75}
LEAST_ROWS = 100
#: A group with more than one in so many rows is a heavy one.
HEAVY = 1000


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the array holds twice or more, the first included."""
    windows = F.filter(F.transform(words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))), lambda x: x.i < F.size(words) - 2)
    ordered = F.array_sort(windows)
    n = F.size(words)
    same = F.zip_with(ordered, F.slice(ordered, F.lit(2), n), lambda a, b: F.when(a.w == b.w, F.array(a.i, b.i)))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    # Each window adds what the one before it doesn't cover.
    return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a.n)


def counted(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns named, and n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    bare = F.btrim(text, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    out = df.select(*keep, F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("__lines"), words.alias("__words"))
    hashes = F.filter(F.transform("__words", lambda w, i: F.when(i < F.size("__words") - 2, F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))), lambda x: x.isNotNull())
    out = out.select(*keep, "n_symbols", "__words", hashes.alias("__hashes"), F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    # Windows that are equal have equal hashes: most texts have none.
    some = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    return out.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.when(some, repeated_words(F.col("__words"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _share(part: str, whole: str, unit: int) -> Column:
    return F.when(F.col(whole) > 0, F.expr(f"({part} * {unit}) DIV {whole}"))


def rates() -> dict[str, Column]:
    """Hundredths of a character a word; thousandths of the others; null without words or lines."""
    return {"word_length": _share("word_chars", "n_words", 100), "symbol_rate": _share("n_symbols", "word_chars", 1000), "line_rate": _share("n_dup_lines", "n_lines", 1000), "repeat_rate": _share("n_repeat_words", "n_words", 1000)}


def bucket(value: Column, bits: int = BITS) -> Column:
    """The smallest number that has the leading binary digits of value: where its bucket begins."""
    shift = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(values: DataFrame, by: list[str]) -> DataFrame:
    """by, rate, bucket, n: of values (by, and one column a rate)."""
    long = values.select(*by, F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in RATES])).alias("x")).where("x.v IS NOT NULL")
    return long.groupBy(*by, F.col("x.rate").alias("rate"), bucket(F.col("x.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of groups as one for each of by."""
    return sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str], fence: int = FENCE) -> DataFrame:
    """by, and low and high as maps from rate to number, by sketches."""
    upto = Window.partitionBy(*by, "rate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "rate")
    cut = sketch.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(whole)})
    quarter = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bucket"))) for k in (1, 3)]
    cut = cut.groupBy(*by, "rate").agg(quarter[0].alias("q1"), quarter[1].alias("q3"))
    least = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])
    reach = F.lit(fence) * F.greatest(F.col("q3") - F.col("q1"), F.element_at(least, F.col("rate")))
    cut = cut.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    return cut.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rate", "low"))).alias("low"), F.map_from_entries(F.collect_list(F.struct("rate", "high"))).alias("high"))


def _equal(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on &= left[c].eqNullSafe(right[f"g_{c}"])
    return on


def group_limits(values: DataFrame, fence: int = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """g_lang, g_source, rows, low, high: one row for each language and source of values (lang, source, and one column a rate)."""
    own = sketches(values, ["lang", "source"])
    sizes = values.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    by_lang = sizes.groupBy(F.col("lang").alias("g_lang")).agg(F.sum("rows").alias("lang_rows"))
    named = lambda df, by: df.select(*[F.col(c).alias(f"g_{c}") for c in by], F.struct("low", "high").alias(f"by_{len(by)}"))
    pair = named(limits(own, ["lang", "source"], fence), ["lang", "source"])
    lang = named(limits(merged(own, ["lang"]), ["lang"], fence), ["lang"])
    every = limits(merged(own, []), [], fence).select(F.struct("low", "high").alias("by_0"))
    out = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("g_lang"))).drop("g_lang")
    out = out.join(pair, _equal(out, pair, ["lang", "source"]), "left").drop("g_lang", "g_source")
    out = out.join(lang, _equal(out, lang, ["lang"]), "left").drop("g_lang").join(F.broadcast(every), F.lit(True), "left")
    chosen = F.when(F.col("rows") >= least_rows, F.col("by_2")).when(F.col("lang_rows") >= least_rows, F.col("by_1")).otherwise(F.col("by_0"))
    return out.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "rows", chosen.alias("limits"))


def _judged(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """rows with the limits of their group in a column limits."""
    table = materialize(table, f"{name}-limits")
    total = table.agg(F.sum("rows").alias("total"))
    table = table.join(F.broadcast(total), F.lit(True), "left")
    heavy = F.col("rows") * HEAVY > F.col("total")
    hot = F.broadcast(table.where(heavy).select("g_lang", "g_source", F.col("limits").alias("hot")))
    cold = table.where(~heavy).select("g_lang", "g_source", F.col("limits").alias("cold"))
    out = rows.join(hot, _equal(rows, hot, ["lang", "source"]), "left").drop("g_lang", "g_source")
    known = out.where("hot IS NOT NULL").select(*rows.columns, F.col("hot").alias("limits"))
    rest = out.where("hot IS NULL").select(*rows.columns)
    return known.unionByName(rest.join(cold, _equal(rest, cold, ["lang", "source"]), "left").select(*rows.columns, F.col("cold").alias("limits")))


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: int = FENCE, least_rows: int = LEAST_ROWS, name: str = "rules"
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed (names of the rates that lie outside their limits, by comma).

    Null texts count as empty ones: they fail the base rules. Null languages and sources are groups like others. Limits come from all rows that have a
    word, whether they fail the base rules or not; rows that are equal count each. Ids are passed through, null or repeated; other columns are ignored,
    whatever their names. Texts of any length are read whole (their words are held at once). An empty table gives no rows.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = materialize(counted(base, ["doc_id", "lang", "source"]).withColumns(rates()), f"{name}-counts")
    judged = _judged(rows, group_limits(rows.where("n_words > 0"), fence, least_rows), name)
    out = [F.when((F.col(r) < F.element_at("limits.low", F.lit(r))) | (F.col(r) > F.element_at("limits.high", F.lit(r))), F.lit(r)) for r in RATES]
    base_failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    judged = judged.withColumn("failed", F.concat_ws(",", *out)).withColumn("base_failed", base_failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")


def drop_bad(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of df that quality_rules keeps, with all their columns; rows that are equal in id, text, language and source fare alike."""
    parts = [F.col(c).cast("string") for c in (id_col, text_col, lang_col, source_col)]
    key = lambda seed: F.xxhash64(F.lit(seed), *[F.coalesce(p, F.lit("")) for p in parts], *[p.isNull() for p in parts])
    keyed = df.select(F.struct(key(1).alias("a"), key(2).alias("b")).alias("k"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    good = quality_rules(keyed, id_col="k", **options).where("kept").select(F.col("doc_id.a").alias("__a"), F.col("doc_id.b").alias("__b")).distinct()
    return df.withColumns({"__k1": key(1), "__k2": key(2)}).join(good, (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b")), "left_semi").select(*df.columns)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, lang, source, t, string_split(t, chr(10)) AS lines, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id
), counts AS (
  SELECT words.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
         (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
), rates AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words END AS word_length,
         CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END AS line_rate,
         CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END AS repeat_rate
  FROM counts
), long AS (
  SELECT lang, source, r.rate, r.v, r.least FROM (
    SELECT lang, source, unnest([{'rate': 'word_length', 'v': word_length, 'least': 25}, {'rate': 'symbol_rate', 'v': symbol_rate, 'least': 5},
                                 {'rate': 'line_rate', 'v': line_rate, 'least': 75}, {'rate': 'repeat_rate', 'v': repeat_rate, 'least': 75}]) AS r
    FROM rates WHERE n_words > 0)
  WHERE r.v IS NOT NULL
), sketch AS (
  SELECT lang, source, rate, least, (v >> greatest(length(bin(v)) - 7, 0)::INT) << greatest(length(bin(v)) - 7, 0)::INT AS bucket, count(*) AS n FROM long GROUP BY ALL
), every AS (
  SELECT 2 AS level, lang, source, rate, least, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, rate, least, bucket, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, rate, least, bucket, sum(n) FROM sketch GROUP BY ALL
), cut AS (
  SELECT level, lang, source, rate, least, min(bucket) FILTER (WHERE upto * 4 >= total) AS q1, min(bucket) FILTER (WHERE upto * 4 >= total * 3) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM every)
  GROUP BY ALL
), fences AS (
  SELECT level, lang, source, rate, q1 - 6 * greatest(q3 - q1, least) AS low, q3 + 6 * greatest(q3 - q1, least) AS high FROM cut
), sizes AS (
  SELECT lang, source, CASE WHEN n >= 100 THEN 2 WHEN of_lang >= 100 THEN 1 ELSE 0 END AS level
  FROM (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS of_lang FROM rates WHERE n_words > 0 GROUP BY lang, source)
), outside AS (
  SELECT c.doc_id, string_agg(r.rate, ',' ORDER BY r.place) AS failed
  FROM (SELECT doc_id, lang, source, unnest([{'rate': 'word_length', 'v': word_length, 'place': 1}, {'rate': 'symbol_rate', 'v': symbol_rate, 'place': 2},
                                             {'rate': 'line_rate', 'v': line_rate, 'place': 3}, {'rate': 'repeat_rate', 'v': repeat_rate, 'place': 4}]) AS r FROM rates) c
  JOIN sizes s ON c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source
  JOIN fences f ON f.level = s.level AND f.rate = r.rate AND (s.level < 1 OR f.lang IS NOT DISTINCT FROM c.lang) AND (s.level < 2 OR f.source IS NOT DISTINCT FROM c.source)
  WHERE r.v < f.low OR r.v > f.high
  GROUP BY c.doc_id
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND failed IS NULL AS kept,
       coalesce(failed, '') AS failed
FROM rates r LEFT JOIN outside o ON r.doc_id = o.doc_id
"""
