"""Splits; the order is md5('42:id') in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import splits
from lodestone.plans.registry import query
from lodestone.sources import readers

_KEY = "md5('42:' || doc_id)"
_PERIOD = "['BIBLICAL','SECOND_TEMPLE','TANNAITIC','AMORAIC','GEONIC','RISHONIM','ACHRONIM','MODERN_HEBREW','DEAR_ABBY'][regexp_extract(source, '(\\d+)$', 1)::INT % 9 + 1]"


@query("SPL1 FLT4", f"""
SELECT role, count(*) AS n FROM (SELECT CASE WHEN p IN ('BIBLICAL','TANNAITIC') THEN 'train' WHEN p = 'AMORAIC' THEN 'valid' WHEN p = 'DEAR_ABBY' THEN 'test' END AS role FROM (SELECT {_PERIOD} AS p FROM documents)) WHERE role IS NOT NULL GROUP BY role""")
def temporal_holdout(t):
    rows = splits.by_values(readers.passages(t("documents")), "time_period", {"train": ["BIBLICAL", "TANNAITIC"], "valid": ["AMORAIC"], "test": ["DEAR_ABBY"]})
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SPL2 JN5", f"""
WITH p AS (SELECT doc_id, {_PERIOD} AS p FROM documents), e AS (SELECT p AS split FROM p GROUP BY p HAVING count(*) >= 100)
SELECT split, CASE WHEN p = split THEN 'test' WHEN substr({_KEY}, 1, 8) <= 'e6666665' THEN 'train' ELSE 'valid' END AS role, doc_id AS id FROM p CROSS JOIN e""")
def leave_era_out(t):
    return splits.leave_one_out(readers.passages(t("documents")), "time_period", "id")


@query("SPL5", f"""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_KEY}) AS k, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS role FROM r""")
def stratified_split(t):
    return splits.by_shares(t("documents").select("doc_id", "lang", "source"), [("train", 0.7), ("valid", 0.15), ("test", 0.15)], "doc_id", strata=["lang", "source"]).select("doc_id", "role")


@query("SPL7 SPL11", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM r""")
def mixed_split(t):
    return splits.by_shares(t("documents").select("doc_id"), [("train", 0.8), ("test", 0.2)], "doc_id").select("doc_id", "role")


@query("SPL6 FLT5 JN7", f"""
WITH g AS (SELECT doc_id, [lang, {_PERIOD}] AS tags FROM documents),
x AS (SELECT 'en_fr' AS split, doc_id AS id, list_has_any(tags, ['en']) AS a, list_has_any(tags, ['fr']) AS b FROM g UNION ALL SELECT 'old_new', doc_id, list_has_any(tags, ['BIBLICAL','TANNAITIC']), list_has_any(tags, ['DEAR_ABBY','en']) FROM g UNION ALL SELECT 'romance_rest', doc_id, list_has_any(tags, ['fr','es']), NOT list_has_any(tags, ['fr','es']) FROM g),
y AS (SELECT split, CASE WHEN a THEN 'train' ELSE 'test' END AS role, id FROM x WHERE a <> b)
SELECT * FROM y WHERE split IN (SELECT split FROM y GROUP BY split HAVING count(*) FILTER (WHERE role = 'train') >= 50 AND count(*) FILTER (WHERE role = 'test') >= 50)""")
def tag_experiments(t):
    rows = readers.passages(t("documents")).select("id", F.array("language", "time_period").alias("tags"))
    old, new = splits.parse_pairs("BIBLICAL, TANNAITIC -> DEAR_ABBY, en")
    return splits.by_tags(rows, [("en_fr", ["en"], ["fr"]), ("old_new", old, new), ("romance_rest", ["romance"], [splits.ALL_OTHER])], "id", "tags", compounds={"romance": ["fr", "es"]})


@query("SPL13", f"SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY {_KEY} LIMIT 200)")
def subsample(t):
    return t("documents").select("doc_id").orderBy(splits.order_key(F.col("doc_id"))).limit(200)


@query("SPL12", f"""
WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('43:' || doc_id)) AS i FROM documents), b AS (SELECT lang, source AS shuffled, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}) AS i FROM documents)
SELECT a.doc_id, b.shuffled FROM a JOIN b ON a.lang = b.lang AND a.i = b.i""")
def shuffled_labels(t):
    return splits.shuffled_labels(t("documents").select("doc_id", "lang", "source"), "source", "lang", "doc_id").select("doc_id", "shuffled")


@query("SPL15", """
WITH m AS (SELECT doc_id, lang FROM documents WHERE source = 'src0'), h AS (SELECT lang, count(*) AS c FROM m GROUP BY lang),
x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE source <> 'src0')
SELECT doc_id, lang FROM m UNION ALL SELECT x.doc_id, x.lang FROM x LEFT JOIN h ON x.lang = h.lang WHERE k <= 40 - coalesce(c, 0)""")
def topped_up(t):
    d = t("documents").select("doc_id", "lang", "source")
    return splits.topped_up(d.where("source = 'src0'").drop("source"), d.where("source <> 'src0'").drop("source"), "lang", ["doc_id"], 40)


@query("SPL16", """
SELECT event_id FROM events WHERE substr(md5('42:' || event_id), 1, 8) <= '4ccccccb'""")
def follow_ups(t):
    return t("events").where(F.substring(splits.order_key(F.col("event_id")), 1, 8) <= f"{int(0.3 * 0xFFFFFFFF):08x}").select("event_id")
