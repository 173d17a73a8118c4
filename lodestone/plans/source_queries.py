"""Round trips: tables are written by the sinks into the shared folder and read back by the readers."""

from __future__ import annotations

import importlib.util

from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import table_functions as TF
from lodestone.functions import text as T
from lodestone.plans.registry import query
from lodestone.session import table_path
from lodestone.sources import readers, sinks, versions


@query("SRC1 SRC2 SNK1 SNK2", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_lines_round_trip(t):
    df = t("conversations")
    path = table_path(df.sparkSession, "json-lines")
    sinks.json_lines(df.where("role = 'user'"), path)
    sinks.json_lines(df.where("role <> 'user'"), path, append=True)
    back = readers.json_lines(df.sparkSession, path, "conv_id bigint, turn bigint, role string, text string", "*.json")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SRC4 SRC7", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS answer FROM customer")
def csv_round_trip(t):
    df = t("customer")
    path = table_path(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    names = {"id": ["id", "C_CUSTKEY"], "name": ["title", "c_name"], "segment": ["c_mktsegment"], "answer": ["answer"]}
    return readers.csv_any(df.sparkSession, path, names, mode="DROPMALFORMED")


@query("SRC5", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 <> 0")
def malformed_rows(t):
    """Every seventh row has a field too many and is left out; the header stands in the first line of each file."""
    df = t("orders")
    path = table_path(df.sparkSession, "csv-malformed")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "too much"))
    rows = df.select(F.pmod("o_orderkey", F.lit(8)).alias("part"), F.lit(1).alias("at"), line.alias("value"))
    head = rows.select("part").distinct().select("part", F.lit(0).alias("at"), F.lit("o_orderkey,o_orderstatus").alias("value"))
    rows.unionByName(head).repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    found = readers.csv_any(df.sparkSession, path, {"id": ["o_orderkey"], "status": ["o_orderstatus"]}, mode="DROPMALFORMED")
    return found


@query("SRC13", "SELECT n_nationkey::VARCHAR AS key, n_regionkey::VARCHAR AS region, n_name AS name FROM nation")
def delimited_round_trip(t):
    df = t("nation")
    path = table_path(df.sparkSession, "delimited")
    df.select(F.concat_ws("|", "n_nationkey", "n_regionkey", "n_name")).write.text(path)
    return readers.delimited(df.sparkSession, path, ["key", "region", "name"])


@query("SRC12", "SELECT c_nationkey::INT AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS ordinal, c_name AS name FROM customer")
def numbered_lines(t):
    """A file for each nation; a line's number in its file is the customer's place."""
    df = t("customer")
    path = table_path(df.sparkSession, "lines")
    df.select("c_nationkey", "c_custkey", "c_name").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    found = readers.lines(df.sparkSession, path).where("value <> ''")
    return found.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation"), F.col("ordinal").cast("int").alias("ordinal"), F.col("value").alias("name"))


@query("SRC9 SRC10 FLT10", """
SELECT 'lang=' || lang AS category, 'source=' || source AS source, count(*) AS n FROM (SELECT lang, source, doc_id % 3 = 0 AS merged, bool_or(doc_id % 3 = 0) OVER (PARTITION BY lang, source) AS any_merged FROM documents) WHERE source <> 'src1' OR merged OR NOT any_merged GROUP BY ALL""")
def tree_round_trip(t):
    """Folders by language and source; those of one source hold a merged file beside others, and only the merged one is read."""
    df = t("documents").select("lang", "source", "doc_id")
    spark, path = df.sparkSession, table_path(df.sparkSession, "tree")
    line = F.to_json(F.struct("doc_id")).alias("value")
    first = df.where("doc_id % 3 = 0").select(line, "lang", "source").repartition("lang", "source")
    second = df.where("doc_id % 3 <> 0").select(line, "lang", "source").repartition("lang", "source")
    first.write.partitionBy("lang", "source").text(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(fs_path(f"{path}/lang=*/source=src1/part-*")):
        fs.rename(f.getPath(), fs_path(f.getPath().getParent(), "merged.json"))
    second.write.mode("append").partitionBy("lang", "source").text(path)
    found = readers.tree(spark, path, glob="*")
    parts = [readers.tree(spark, path, glob="*", category=f"lang={x}").select("path") for x in ("en", "de")]
    only = parts[0].unionByName(parts[1]).distinct().withColumnRenamed("path", "chosen")
    rest = found.join(only, F.col("path") == F.col("chosen"), "left_anti")
    every = found.join(only, F.col("path") == F.col("chosen"), "left_semi").unionByName(rest)
    return every.select("category", "source", F.explode(F.split("value", "\n")).alias("line")).where("line <> ''").groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SRC15 SRC16", r"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), 1) - 1 AS ordinal FROM pages)
SELECT page_id, ordinal::INT AS ordinal, md5(regexp_replace(x, '<[^>]+>', ' ', 'g')) AS text_md5 FROM s""")
def page_segments(t):
    rows = t("pages").select("page_id", F.posexplode(readers.segments(F.col("html"), "p")).alias("ordinal", "x"))
    return rows.select("page_id", "ordinal", F.md5(readers.stripped_tags(F.col("x"))).alias("text_md5"))


@query("SRC17 SRC18", r"""
WITH w AS (SELECT unnest(string_split(text, ' ')) AS value, generate_subscripts(string_split(text, ' '), 1) AS number FROM benchmark)
SELECT number::INT AS number, count(*) AS n, min(value COLLATE C) AS first FROM w GROUP BY number""".replace(" COLLATE C", ""))
def numbered_entries(t):
    """Words under their numbers as keys of a map, beside a key that is no number; entries come in the order of the numbers."""
    words = F.split("text", " ")
    entries = F.transform(words, lambda w, i: F.struct((i + 1).cast("string").alias("k"), w.alias("v")))
    maps = t("benchmark").select(F.map_from_entries(F.concat(entries, F.array(F.struct(F.lit("title").alias("k"), F.lit("x").alias("v"))))).alias("m"))
    return readers.numbered(maps, "m").groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"))


@query("SRC22", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def snapshot_round_trip(t):
    """The second call finds the table and doesn't build it again; the third lacks a column and does."""
    df = t("orders")
    spark, path = df.sparkSession, table_path(df.sparkSession, "snapshot")
    counts = lambda: df.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    readers.snapshot(spark, path, lambda: counts().drop("n"), ["priority"])
    readers.snapshot(spark, path, counts, ["priority", "n"])

    def never():
        raise AssertionError("built again")

    return readers.snapshot(spark, path, never, ["priority", "n"])


@query("SNK5", "SELECT count(*) AS n, true AS bounded, sum(l_linenumber)::BIGINT AS lines FROM lineitem")
def chunked_round_trip(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber")
    path = table_path(df.sparkSession, "chunked")
    sinks.chunked(df, path, 500)
    files = df.sparkSession.read.schema("l_orderkey bigint, l_linenumber int").json(path).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("bounded"), F.sum("lines").alias("lines"))


@query("SNK4", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def statistics_documents(t):
    """Statistics by language, each as one JSON document, written and read back."""
    stats = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    path = table_path(stats.sparkSession, "statistics")
    sinks.document(stats).write.text(path)
    return readers.json_lines(stats.sparkSession, path, "lang string, n bigint, chars bigint", "*.txt").drop("_corrupt")


@query("SRC25 SRC6 SRC19", """
SELECT CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' ELSE 'other' END AS category, count(*) AS n FROM (
  SELECT role, row_number() OVER (ORDER BY conv_id, turn) AS k, count(*) OVER () AS n FROM conversations) WHERE k <= n // 2 GROUP BY ALL""")
def capped_lines(t):
    """Remote lines with their categories renamed, and a cap on the rows: the first half in order."""
    df = t("conversations").select("conv_id", "turn", "role")
    path = table_path(df.sparkSession, "capped")
    sinks.json_lines(df, path)
    cap = df.count() // 2
    rows = readers.json_lines(df.sparkSession, path, "conv_id bigint, turn bigint, role string", "*.json").orderBy("conv_id", "turn").limit(cap)
    return rows.select(T.lookup(F.col("role"), {"user": "question", "assistant": "answer"}, "other").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SRC24", """
WITH c AS (SELECT item_id, item_id % 5 = 0 AS failed, string_split(text, chr(10)) AS ls FROM benchmark)
SELECT item_id % 3 AS period, count(*) FILTER (WHERE failed) AS failures, coalesce(sum(CASE WHEN NOT failed THEN len(list_filter(ls, lambda x: length(x) > 10)) END), 0)::BIGINT AS texts FROM c GROUP BY ALL""")
def chapters(t):
    """Landed answers of a chapter service: lines of a text as its fulltext, every fifth one broken; texts beyond ten characters, and failures, by period."""
    df = t("benchmark")
    path = table_path(df.sparkSession, "chapters")
    answer = F.when(F.col("item_id") % 5 == 0, F.lit("service unavailable")).otherwise(F.to_json(F.struct(F.split("text", "\n").alias("fulltext"))))
    df.select(F.to_json(F.struct((F.col("item_id") % 3).alias("period"), answer.alias("answer"))).alias("value")).write.text(path)
    return readers.chapters(readers.json_lines(df.sparkSession, path, "period bigint, answer string", "*.txt"), "answer", "period")


@query("SRC8", "SELECT r_regionkey, r_name FROM region")
def json_document_round_trip(t):
    df = t("region")
    path = table_path(df.sparkSession, "json-document")
    # A table of a few rows, as one document.
    df.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("r_regionkey", "r_name")).alias("letters")))).write.text(path)
    return readers.json_documents(df.sparkSession, path, "struct<r_regionkey:int,r_name:string>")


@query("SNK6", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def partitioned_round_trip(t):
    df = t("orders")
    path = table_path(df.sparkSession, "by-status")
    sinks.by_key(df.select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return df.sparkSession.read.parquet(path).where("o_orderstatus = 'F'").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


if importlib.util.find_spec("yaml"):

    @query("SRC11", """
SELECT item_id, md5(text) AS text_md5, NULL::VARCHAR AS reason FROM benchmark WHERE item_id % 7 <> 0
UNION ALL SELECT NULL, NULL, 'lacks text' FROM benchmark WHERE item_id % 7 = 0 UNION ALL SELECT NULL, NULL, 'not YAML' FROM (SELECT DISTINCT item_id % 3 FROM benchmark)""")
    def yaml_round_trip(t):
        """Items as YAML, a file a remainder, beside a broken file each; every seventh item lacks its text."""
        df = t("benchmark")
        path = table_path(df.sparkSession, "yaml")
        item = F.concat(F.lit("- "), F.to_json(F.struct("item_id", F.when(F.col("item_id") % 7 != 0, F.col("text")).alias("text"))))
        rows = df.select((F.col("item_id") % 3).alias("part"), item.alias("value"))
        rows.repartition("part").write.partitionBy("part").text(path)
        rows.select("part").distinct().select("part", F.lit("- {broken: [").alias("value")).repartition("part").write.mode("append").partitionBy("part").text(path)
        found = readers.read_yaml(df.sparkSession, path, "item_id bigint, text string", required=("text",), errors=True)
        return found.select("item_id", F.md5("text").alias("text_md5"), F.regexp_replace("_error", r"^item \d+ ", "").alias("reason"))


@query("SNK3", "SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 11 <> 0")
def rewritten_labels(t):
    """A table rewritten from itself: two changes, each a new version beside the one it reads."""
    df = t("labels")
    spark, path = df.sparkSession, table_path(df.sparkSession, "labels")
    versions.write(df, path)
    versions.rewrite(spark, path, lambda old: old.withColumn("quality", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality"))))
    versions.rewrite(spark, path, lambda old: old.where("doc_id % 11 <> 0"))
    return versions.read(spark, path)


_NESTED = """
docs AS (
  SELECT conv_id, turn, to_json(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' '))) AS a,
    CASE WHEN turn % 4 = 3 THEN NULL ELSE to_json(list_transform(string_split(reverse(text), chr(10))[1:greatest(len(string_split(text, chr(10))) - 1, 1)], lambda l: string_split(l, ' '))) END AS b FROM conversations
)"""


def _nested(t):
    """Lines of words of each turn; on the other side the same from the end, without the last line, and nothing in every fourth turn."""
    lines = F.split("text", "\n")
    words = lambda ls: F.to_json(F.transform(ls, lambda x: F.split(x, " ")))
    shorter = F.slice(F.split(F.reverse("text"), "\n"), F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1)))
    return t("conversations").select("conv_id", "turn", words(lines).alias("a"), F.when(F.col("turn") % 4 != 3, words(shorter)).alias("b"))


@query("EXP1 EXP2 EXP4", f"""
WITH RECURSIVE {_NESTED}, walk AS (
  SELECT conv_id, turn, '' AS path, a::JSON AS a, b::JSON AS b FROM docs
  UNION ALL
  SELECT conv_id, turn, CASE WHEN path = '' THEN '' ELSE path || '.' END || i, CASE WHEN json_type(a) = 'ARRAY' THEN json_extract(a, '$[' || (i - 1) || ']') END, CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[' || (i - 1) || ']') END
  FROM (SELECT *, unnest(range(1, CASE WHEN json_type(a) = 'ARRAY' AND json_type(b) = 'ARRAY' THEN least(json_array_length(a), json_array_length(b)) WHEN json_type(a) = 'ARRAY' THEN json_array_length(a) ELSE json_array_length(b) END::BIGINT + 1)) AS i
        FROM walk WHERE json_type(a) = 'ARRAY' OR json_type(b) = 'ARRAY')
)
SELECT conv_id, turn, path, a->>'$' AS first, b->>'$' AS second FROM walk WHERE json_type(a) = 'VARCHAR' OR json_type(b) = 'VARCHAR'""")
def nested_rows(t):
    """Two nested texts walked side by side, by a table function in a lateral join."""
    spark = t.spark
    TF.register(spark)
    _nested(t).createOrReplaceTempView("nested_turns")
    return spark.sql("SELECT conv_id, turn, f.path, f.first, f.second FROM nested_turns, LATERAL flatten_pairs(a, b) f")


@query("EXP3", """
SELECT conv_id, turn, count(*) AS n, sum(length(x))::BIGINT AS chars, min(x) AS least FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x FROM conversations UNION ALL SELECT conv_id, turn, 'turn of the conversation: ' || role FROM conversations WHERE turn % 2 = 0) WHERE length(x) > 20 GROUP BY ALL""")
def collected_texts(t):
    """Texts beyond 20 characters, of nested objects down to a depth: lines under a key, the role deeper, and one too deep to be found."""
    spark = t.spark
    TF.register(spark)
    role = F.concat(F.lit("turn of the conversation: "), F.col("role"))
    inner = F.when(F.col("turn") % 2 == 0, F.struct(F.array(role).alias("content"))).otherwise(F.struct(F.array(F.lit("short")).alias("content")))
    deep = F.array(F.array(F.array(F.array(F.array(F.lit("this text lies too deep to be collected"))))))
    document = F.struct(F.split("text", "\n").alias("text"), inner.alias("he"), F.lit("a text under a key that nobody looks into").alias("note"), deep.alias("content"))
    t("conversations").select("conv_id", "turn", F.to_json(document).alias("json")).createOrReplaceTempView("documents_of_turns")
    rows = spark.sql("SELECT conv_id, turn, f.text FROM documents_of_turns, LATERAL collect_texts(json, 5, 20) f")
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min("text").alias("least"))


@query("AG9 PRJ5 PRJ8", r"""
SELECT event_type AS protocol, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE value < 0.5) / count(*) / 2.0::DOUBLE ELSE 0 END, 9) AS index, (SELECT max(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) FROM benchmark)::INT AS words
FROM events GROUP BY event_type""")
def registered_functions(t):
    """Functions that register() makes known, called from SQL."""
    spark = t.spark
    TF.register(spark)
    t("events").createOrReplaceTempView("registered_events")
    t("benchmark").createOrReplaceTempView("registered_items")
    out = spark.sql("SELECT event_type AS protocol, bond_index(count_if(value < 0.5), count(*), 2.0D) AS index, (SELECT max(word_count(text)) FROM registered_items) AS words FROM registered_events GROUP BY event_type")
    return out.withColumn("index", F.round("index", 9))
