"""URL filters (operator 6): native Spark expressions only.

Each distinct URL is expanded into host-suffix and path-prefix expressions ("b.c/", "b.c/x/" ...).
Expressions meet the rules in an equi-join on the first 32 bits of their
SHA-256; the full digest then confirms the match, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.line_dedup import LOWER, UPPER

#: The rules of the contract (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Up to so many rules (some 100 bytes each) are broadcast; longer lists are shuffled, and hashed on their side of the join.
MOST_BROADCAST = 100_000
#: Parts of a pair of host and path, by page: a home page may have a third of all rows.
SALTS = 16


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _host_suffixes(host: Column, most: int) -> Column:
    """Suffixes of up to `most` labels: no rule has more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.greatest(n - most + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _path_prefixes(path: Column, most: int, lengths: Sequence[int]) -> Column:
    """Prefixes that end in "/", up to `most` of them (no rule has more "/"), and those of the given lengths (of the rules that end otherwise)."""
    parts = F.split(path, "/", most + 1)
    ends = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    if not lengths:
        return ends
    own = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(ends, own))


def url_filter(
    df: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    rules: (verdict, "host/path") pairs. A rule fits its host and all subdomains of it if the path starts with
    the rule's. The longest rule text wins; of two that are as long, the one with the longer host, then the last in text order, then "block".
    Where none fits, rule is null and verdict is default. Null URLs, and those without "://",
    have an empty host and path. Ids are passed through, null or repeated; other columns are ignored. Of very long URLs only as many
    labels and segments are expanded as the rules have. An empty table gives no rows; without rules every verdict is the default.
    """
    spark = df.sparkSession
    lengths = sorted({len(r) - r.index("/") for _, r in rules if not r.endswith("/")})
    labels = max((r[: r.index("/")].count(".") + 1 for _, r in rules), default=1)
    slashes = max((r.count("/") for _, r in rules), default=1)
    table = spark.createDataFrame([(r, v, r.index("/")) for v, r in rules], "rule string, rule_verdict string, host_length int")
    table = table.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("rule_prefix", F.substring("rule_digest", 1, 8))
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    # Rules see the host and the directories of a path only, so pages that share them are judged once.
    seen = rows.where("host <> ''").select("host", F.col("path").alias("p")).distinct()
    expressions = seen.select(
        "host", "p", F.explode(_host_suffixes(F.col("host"), labels)).alias("suffix")
    ).select("host", "p", "suffix", F.explode(_path_prefixes(F.col("p"), slashes, lengths)).alias("prefix"))
    expressions = expressions.select("host", "p", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
    # Never the pages, however small their estimate: the expressions grow with them.
    table = F.broadcast(table) if len(rules) <= MOST_BROADCAST else table.hint("shuffle_hash")
    fits = expressions.join(table, F.substring("digest", 1, 8) == F.col("rule_prefix")).where(F.col("digest") == F.col("rule_digest"))
    best = fits.groupBy("host", "p").agg(
        F.max(F.struct(F.char_length("rule").alias("n"), "host_length", "rule", "rule_verdict")).alias("best")
    )
    best = best.select(F.col("host").alias("bh"), F.col("p").alias("bp"), "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # Rows without a host match nothing, and must not meet in one task.
    key = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("?"), F.pmod(F.xxhash64("page_id"), F.lit(4096)).cast("string")))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    out = rows.join(best, (key == F.col("bh")) & (F.col("path") == F.col("bp")) & (part == F.col("salt")), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), rules(verdict, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM q) d
  JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)
  GROUP BY host, path
)
SELECT q.page_id, q.host, q.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM q LEFT JOIN best b ON q.host = b.host AND q.path = b.path
"""
