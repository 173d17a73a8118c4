"""Joins, aggregates, top-k, sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import splits
from lodestone.plans.registry import query
from lodestone.session import table_path
from lodestone.sources import readers, sinks


@query("JN1 JN3", "SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def labelled_join(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("JN2 JN4 AG28", """
SELECT lang, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, sum(coalesce(quality, -1))::BIGINT AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def labelled_or_not(t):
    d = t("documents").select("doc_id", "lang").join(t("labels").withColumn("there", F.lit(1)), "doc_id", "left")
    return d.groupBy("lang").agg(F.count_if(F.col("there").isNull()).alias("unlabelled"), F.sum(F.coalesce("quality", F.lit(-1))).alias("total"))


@query("JN5", "SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0) GROUP BY lang")
def without_clean_label(t):
    return t("documents").select("doc_id", "lang").join(t("labels").where("toxic = 0"), "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("JN7 SET2 SET3", """
WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT 'a' AS side, count(*) AS n FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)
UNION ALL SELECT 'b', count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)
UNION ALL SELECT 'both', count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)""")
def overlap_removal(t):
    a, b = t("documents").where("lang = 'en'").select("doc_id"), t("labels").where("quality = 1").select("doc_id")
    left, right = splits.without_overlap(a, b, "doc_id")
    parts = {"a": left, "b": right, "both": a.intersect(b)}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n") for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("JN8", """
SELECT a.o_custkey AS signature, a.o_orderkey AS id_old, b.o_orderkey AS id_new FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate""")
def cross_era_pairs(t):
    return splits.cross_pairs(t("orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("JN8 SPL4", """
SELECT o_orderkey AS id, o_custkey AS signature, count(*) OVER w - count(*) OVER p AS n_older, count(*) OVER (PARTITION BY o_custkey) - count(*) OVER w AS n_newer FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate), p AS (PARTITION BY o_custkey, o_orderdate)""")
def cross_era_links(t):
    """How many older and newer orders each order pairs with; the pairs themselves are not made."""
    return splits.cross_links(t("orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("JN13 JN14", """
SELECT c_custkey, n_name, coalesce(r_name, 'generic') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def lookups(t):
    region = t("region").where("r_regionkey < 3")
    out = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "n_name", F.coalesce("r_name", F.lit("generic")).alias("region"))


@query("JN12", """
SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS only_labels, count(*) FILTER (WHERE l.doc_id IS NULL) AS only_documents FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def key_mismatches(t):
    d, l = t("documents").select(F.col("doc_id").alias("a")), t("labels").select(F.col("doc_id").alias("b"))
    return d.join(l, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNull()).alias("only_labels"), F.count_if(F.col("b").isNull()).alias("only_documents"))


@query("AG1 AG6", """
SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, max(count(*)) OVER () / sum(count(*)) OVER () > 0.7 AS dominated FROM documents GROUP BY source""")
def counts_by_source(t):
    n = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"), (F.col("top") / F.col("total") > 0.7).alias("dominated"))


@query("AG4", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY event_type")
def distinct_counts(t):
    return t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.date_trunc("day", "ts")).alias("days"))


@query("AG5", """
SELECT 'event_type' AS key, event_type AS value, count(*) AS n, count(*) FILTER (WHERE value > 100) AS large FROM events GROUP BY event_type
UNION ALL SELECT 'user', user_id::VARCHAR, count(*), count(*) FILTER (WHERE value > 100) FROM events GROUP BY user_id""")
def grouping_sets(t):
    e = t("events").select("event_type", F.col("user_id").cast("string").alias("user"), "value")
    sets = e.groupingSets([["event_type"], ["user"]], "event_type", "user").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("large"), F.grouping("user").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "event_type").otherwise("user").alias("key"), F.when(F.col("g") == 1, F.col("event_type")).otherwise(F.col("user")).alias("value"), "n", "large")


@query("AG26 FLT8 FLT13", "SELECT lang, count(*) AS n, CASE WHEN count(*) >= 150 THEN 'OK' ELSE 'NEED ' || (150 - count(*)) || ' MORE' END AS status FROM documents GROUP BY lang HAVING count(*) >= 50")
def minimum_sizes(t):
    n = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    return n.withColumn("status", F.when(F.col("n") >= 150, "OK").otherwise(F.concat(F.lit("NEED "), 150 - F.col("n"), F.lit(" MORE"))))


@query("TK1 TK3 TK5 TK8", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_sources(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("TK2 TK4 TK6", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(t):
    return splits.capped(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("TK7 AG11", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def modal_event(t):
    from lodestone.operators.judgement import modal_value

    return modal_value(t("events"), ["user_id"], "event_type", "event_id", "event_type")


@query("SET1 SET4", """
SELECT kind, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT 'd' AS kind, text FROM documents UNION ALL SELECT 'b', text FROM benchmark UNION ALL SELECT 'c', text FROM conversations) GROUP BY kind""")
def corpus_union(t):
    parts = [t(n).select(F.lit(k).alias("kind"), "text") for k, n in (("d", "documents"), ("b", "benchmark"), ("c", "conversations"))]
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts"))


@query("AG16 AG17", """
SELECT lang AS domain, count(*) AS n, round(avg((coalesce(state, '') = 'O')::INT::DOUBLE), 9) AS share_o, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
FROM (SELECT lang, source, CASE WHEN length(text) % 3 = 0 THEN 'O' WHEN length(text) % 3 = 1 THEN 'L' END AS state FROM documents) GROUP BY lang""")
def domain_modules(t):
    from lodestone.operators.judgement import module_summary

    n = F.char_length("text") % 3
    rows = t("documents").select("lang", "source", F.when(n == 0, "O").when(n == 1, "L").alias("state"))
    return module_summary(rows, "lang", "state", "source").select(F.col("lang").alias("domain"), "n", F.round("share_o", 9).alias("share_o"), F.array_join("sources", ",").alias("sources"))


@query("SNK8", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM c)
SELECT (SELECT sum(n) FROM c)::BIGINT AS total, place::INT AS place, source, n FROM t WHERE place <= 5""")
def source_report(t):
    """The report of the largest sources as a JSON document, written, and taken apart again."""
    report = sinks.report(t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n")
    path = table_path(report.sparkSession, "report")
    report.write.text(path)
    back = readers.json_lines(report.sparkSession, path, "total bigint, top array<struct<key:string,n:bigint>>", "*.txt")
    return back.select("total", F.posexplode("top").alias("place", "x")).select("total", (F.col("place") + 1).alias("place"), F.col("x.key").alias("source"), F.col("x.n").alias("n"))


@query("AG18 ST25", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation, count(*) / max(count(*)) OVER () < 0.1 AS flagged FROM lineitem GROUP BY l_returnflag""")
def mean_and_deviation(t):
    n = t("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("deviation"))
    return n.withColumn("flagged", F.col("n") / F.max("n").over(W.partitionBy(F.lit(1))) < 0.1)


@query("SRC18 SRC17 EXP9", """
SELECT event_type, k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, (props->>'$.k')::INT % 10 AS k FROM events) GROUP BY event_type, k""")
def property_counts(t):
    m = F.from_json("props", "map<string,int>")
    rows = t("events").select("event_type", "value", F.explode(m).alias("name", "k")).where("name = 'k'")
    return rows.groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
