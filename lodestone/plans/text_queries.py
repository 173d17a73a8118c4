"""Queries over single texts: derivation, cleaning, normalisation, filters, flattening, perturbation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import flatten, perturb
from lodestone.plans.registry import query
from lodestone.sources import readers

WORDS = r"len(list_filter(string_split_regex({0}, '[ \t\n\x0b\f\r]+'), lambda x: x <> ''))"


@query("PRJ1 PRJ2 PRJ5 PRJ10 PRJ11", f"""
SELECT doc_id AS id, lang AS language, ({WORDS.format('text')})::INT AS words,
  ['BIBLICAL','SECOND_TEMPLE','TANNAITIC','AMORAIC','GEONIC','RISHONIM','ACHRONIM','MODERN_HEBREW','DEAR_ABBY'][regexp_extract(source, '(\\d+)$', 1)::INT % 9 + 1] AS time_period,
  [-6,-2,2,4,8,12,17,20,0][regexp_extract(source, '(\\d+)$', 1)::INT % 9 + 1] AS century
FROM documents""")
def passage_projection(t):
    return readers.passages(t("documents")).select("id", "language", X.word_count(F.col("text")).alias("words"), "time_period", "century")


@query("PRJ3 PRJ16 PRJ17", r"""
SELECT item_id, 'QUESTION: ' || text || chr(10) || chr(10) || 'ANSWER: ' || substr(text, 1, 20) AS qa,
  CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS short,
  CASE WHEN starts_with(lower(ltrim(text)), 'the') THEN text ELSE 'The letter' || chr(10) || chr(10) || text END AS opened
FROM benchmark""")
def letter_texts(t):
    c = F.col("text")
    return t("benchmark").select("item_id", X.question_answer(c, F.substring(c, 1, 20)).alias("qa"), X.shorten(c).alias("short"), X.with_opener(c, "The letter").alias("opened"))


@query("PRJ4 SRC15", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(nfc_normalize(html), '<[^>]+>', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS body FROM pages""")
def clean_pages(t):
    return t("pages").select("page_id", X.clean_text(F.col("html")).alias("body"))


@query("PRJ6 PRJ7", r"""
SELECT o_orderkey, y AS year, CASE WHEN y < 2000 THEN 20 ELSE 21 END AS century
FROM (SELECT o_orderkey, coalesce(nullif(regexp_extract(strftime(o_orderdate, '%d %Y'), '((19|20)\d{2})', 1), '')::INT, 1990) AS y FROM orders)""")
def order_centuries(t):
    year = X.year_of(F.date_format("o_orderdate", "dd yyyy"))
    return t("orders").select("o_orderkey", year.alias("year"), X.century_of(year).alias("century"))


@query("PRJ8 PRJ15", r"""
SELECT doc_id, 'p_' || substr(md5(source || ':' || doc_id || ':' || substr(text, 1, 50)), 1, 12) AS content_id,
  array_to_string(list_filter(string_split_regex(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z \t\n\x0b\f\r]', '', 'g')), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')[1:4], '_') AS slug
FROM documents""")
def content_ids(t):
    c = F.col("text")
    return t("documents").select("doc_id", X.content_id("p", F.col("source"), F.col("doc_id").cast("string"), F.substring(c, 1, 50)).alias("content_id"), X.slug(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("slug"))


@query("PRJ10 PRJ12 PRJ14", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'BIBLICAL' WHEN contains(lower(p_name), 'widget') THEN 'TANNAITIC' WHEN contains(lower(p_name), 'bolt') THEN 'RISHONIM' ELSE 'AMORAIC' END AS period,
  CASE p_brand WHEN 'Brand#2' THEN 'exact_brand' ELSE CASE p_type WHEN 'ECONOMY' THEN 'exact_type' ELSE CASE WHEN contains(lower(p_name), 'red') THEN 'fuzzy' ELSE 'general' END END END AS domain
FROM part""")
def period_lookup(t):
    name = F.col("p_name")
    domain = F.coalesce(F.when(F.col("p_brand") == "Brand#2", "exact_brand"), F.when(F.col("p_type") == "ECONOMY", "exact_type"), F.lit(None).cast("string"))
    return t("part").select("p_partkey", X.first_containing(name, {"ring": "BIBLICAL", "widget": "TANNAITIC", "bolt": "RISHONIM"}, "AMORAIC").alias("period"), F.coalesce(domain, X.first_containing(name, {"red": "fuzzy"}, "general")).alias("domain"))


@query("PRJ18 PRJ19 PRJ20", """
SELECT event_id, CASE WHEN lower(event_type) = 'high' THEN 2.0::DOUBLE WHEN value / 500 >= 0.8 THEN 2.0 ELSE 1.0 END AS weight,
  concat_ws(',', (event_type = 'view')::INT, (event_type = 'click')::INT, (event_type = 'error')::INT) AS hot,
  CASE event_type WHEN 'view' THEN 'CARE' WHEN 'click' THEN 'AUTONOMY' WHEN 'error' THEN 'HARM_PREVENTION' ELSE 'NONE' END AS bond
FROM events""")
def recoded_events(t):
    bond = X.lookup(F.col("event_type"), {"view": "CARE", "click": "AUTONOMY", "error": "HARM_PREVENTION"}, "NONE")
    return t("events").select("event_id", X.confidence_weight((F.col("value") / 500).cast("string")).alias("weight"), F.concat_ws(",", X.multi_hot(F.array("event_type"), ["view", "click", "error"]).cast("array<string>")).alias("hot"), bond.alias("bond"))


@query("PRJ23 NRM5", r"""
SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\x{00C0}-\x{024F}]', '', 'g'))::DOUBLE / length(text) ELSE 0 END, 9) AS share FROM documents""")
def script_shares(t):
    return t("documents").select("doc_id", F.round(X.script_share(F.col("text"), "\\u00C0", "\\u024F"), 9).alias("share"))


@query("NRM4 PRJ4", """
SELECT doc_id, md5(translate(lower(nfc_normalize(text)), 'ṃṅñṭḍṇḷāīū', 'mnntdnlaiu')) AS folded FROM documents""")
def folded_texts(t):
    return t("documents").select("doc_id", F.md5(X.normalise(F.col("text"), F.lit("pali"))).alias("folded"))


#: Letters for a to z in each script, with marks and variants that its normalisation drops or folds.
_VARIANTS = {
    "hebrew": "\u05d0\u05d1\u05d2\u05d3\u05d4\u05d5\u05d6\u05d7\u05d8\u05d9\u05da\u05db\u05dc\u05dd\u05de\u05df\u05e0\u05e1\u05b7\u05e3\u05e4\u05e5\u05e6\u05e7\u05bc\u05ea",
    "arabic": "\u0623\u0628\u0629\u062a\u0649\u062b\u0625\u062c\u0622\u062d\u064e\u0640\u062e\u062f\u0630\u0631\u0632\u0633\u0634\u064f\u0635\u0636\u0637\u0638\u0639\u063a",
    "sanskrit": "\u0915\u0916\u0917\u0902\u0918\u0919\u0901\u091a\u0951\u091b\u091c\u091d\u091e\u091f\u0920\u0952\u0921\u0922\u0923\u0924\u0925\u0926\u0927\u0928\u092a\u092b",
}
_ABC = "abcdefghijklmnopqrstuvwxyz"


def _folded_sql(name: str) -> str:
    x = f"translate(lower(text), '{_ABC}', '{_VARIANTS[name]}')"
    if name == "sanskrit":
        return f"regexp_replace({x}, '[\u0900-\u0902\u0951-\u0954]', '', 'g')"
    drop, old, new = {"hebrew": ("\u0591-\u05c7", "\u05da\u05dd\u05df\u05e3\u05e5", "\u05db\u05de\u05e0\u05e4\u05e6"), "arabic": ("\u064b-\u065f\u0640", "\u0623\u0625\u0622\u0671\u0629\u0649", "\u0627\u0627\u0627\u0627\u0647\u064a")}[name]
    return f"translate(regexp_replace({x}, '[{drop}]', '', 'g'), '{old}', '{new}')"


@query("NRM1 NRM2 NRM3 NRM5", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS language, md5({_folded_sql(n)}) AS text_md5 FROM documents" for n in _VARIANTS) + " UNION ALL SELECT doc_id, 'english', md5(lower(text)) FROM documents")
def normalised_texts(t):
    """Texts in letters of three scripts, with marks and variants; and in lower case."""
    rows = t("documents").select("doc_id", F.explode(F.array(*map(F.lit, [*_VARIANTS, "english"]))).alias("language"), "text")
    script = F.coalesce(*[F.when(F.col("language") == n, F.translate(F.lower("text"), _ABC, x)) for n, x in _VARIANTS.items()], F.col("text"))
    rows = rows.select("doc_id", "language", F.explode(F.array(script)).alias("text"))
    return rows.select("doc_id", "language", F.md5(X.normalise(F.col("text"), F.col("language"))).alias("text_md5"))


@query("FLT1 FLT2 FLT3 FLT4", """
SELECT doc_id, lang FROM documents
WHERE length(text) BETWEEN 50 AND 2000 AND text IS NOT NULL AND text <> '' AND text <> 'nan' AND NOT starts_with(text, 'No.') AND NOT contains(text, '[') AND lang IN ('en', 'fr', 'de')""")
def length_band(t):
    c = F.col("text")
    return t("documents").where(F.char_length(c).between(50, 2000) & c.isNotNull() & (c != "") & (c != "nan") & ~c.startswith("No.") & ~F.contains(c, F.lit("[")) & F.col("lang").isin("en", "fr", "de")).select("doc_id", "lang")


@query("EXP5", r"""
SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '')) AS paragraph FROM documents""")
def paragraph_rows(t):
    """A line that ends a sentence gets a blank line behind it; other lines stay in their paragraph."""
    return t("documents").select("doc_id", F.explode(flatten.paragraphs(F.replace("text", F.lit(".\n"), F.lit(".\n \n")))).alias("paragraph"))


@query("EXP6 EXP7", r"""
WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: length(x)) AS w,
  list_transform(list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x)) AS p FROM documents),
f AS (SELECT doc_id, list_reduce(list_prepend({'n': 0, 'o': 0}, list_transform(w, lambda x: {'n': 0, 'o': x})), lambda a, x: CASE WHEN (CASE WHEN a.o = 0 THEN x.o ELSE a.o + 1 + x.o END) >= 400
    THEN {'n': a.n + 1, 'o': 0} ELSE {'n': a.n, 'o': CASE WHEN a.o = 0 THEN x.o ELSE a.o + 1 + x.o END} END) AS c,
  list_reduce(list_prepend({'n': 0, 'o': 0}, list_transform(p, lambda x: {'n': 0, 'o': x})), lambda a, x: CASE WHEN a.o + x.o < 1500 THEN {'n': a.n, 'o': CASE WHEN a.o = 0 THEN x.o ELSE a.o + 2 + x.o END}
    ELSE {'n': CASE WHEN a.o = 0 THEN a.n ELSE a.n + 1 END, 'o': x.o} END) AS q FROM w)
SELECT doc_id, c.n + CASE WHEN c.o > 50 THEN 1 ELSE 0 END AS chunks, q.n + CASE WHEN q.o > 0 THEN 1 ELSE 0 END AS packed FROM f""")
def chunk_rows(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.size(flatten.chunks(c)).alias("chunks"), F.size(flatten.packed_paragraphs(F.regexp_replace(c, "\n", "\n\n"))).alias("packed"))


@query("EXP10 EXP11 SET5 FLT5", """
WITH tagged AS (
  SELECT doc_id, unnest(list_sort(list_distinct(list_concat(CASE lang WHEN 'en' THEN ['western','modern'] WHEN 'fr' THEN ['western'] ELSE ['other'] END,
    CASE regexp_extract(source, '(\\d+)$', 1)::INT % 9 WHEN 0 THEN ['ancient'] WHEN 8 THEN ['modern'] ELSE [] END)))) AS tag FROM documents)
SELECT tag, count(*) AS n FROM (SELECT unnest(CASE tag WHEN 'western' THEN ['west_a','west_b'] ELSE [tag] END) AS tag FROM tagged) GROUP BY tag""")
def tag_counts(t):
    tags = flatten.tags(F.col("language"), F.col("time_periods"), {"en": ["western", "modern"], "fr": ["western"], "de": ["other"], "es": ["other"]}, {"BIBLICAL": ["ancient"], "DEAR_ABBY": ["modern"]})
    rows = readers.passages(t("documents")).select("id", F.explode(tags).alias("tag"))
    return flatten.expanded_tags(rows, {"western": ["west_a", "west_b"]}).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("PT3 RUL24", """
WITH f(kind, old, new) AS (VALUES ('a', 'the ', 'a '), ('a', 'of ', 'from '), ('b', 'and ', 'or '))
SELECT doc_id AS id, kind, old, md5(replace(text, old, new)) AS text_md5 FROM documents JOIN f ON contains(text, old)""")
def fuzzed_texts(t):
    families = {"a": [("the ", "a "), ("of ", "from ")], "b": [("and ", "or ")]}
    return perturb.fuzz(t("documents"), families, "doc_id", "text").select("id", "kind", "old", F.md5("text").alias("text_md5"))


@query("PT1 PT2", r"""
SELECT item_id, CASE WHEN contains(lower(text), 'the ') THEN regexp_replace(text, '(?is)^(.*?)the ', '\1each ') END AS changed FROM benchmark""")
def structural_texts(t):
    families = {"determiner": [("the ", "each ")]}
    return t("benchmark").select("item_id", perturb.structural(F.col("text"), families)["text"].alias("changed"))


_DETAILS = ["It was a clear day.", "The room was quiet.", "A clock struck nine."]
_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"


def _swapped_sql(old: str, new: str, same_case: bool) -> str:
    word = "x" if same_case else "lower(x)"
    return f"array_to_string(list_transform({_WORDS}, lambda x: CASE WHEN {word} = '{old}' THEN '{new}' ELSE x END), '')"


@query("PT4", f"""
WITH w AS (SELECT item_id, text, {_WORDS} AS w FROM (SELECT item_id, text FROM benchmark)), l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw FROM w)
SELECT item_id, CASE WHEN list_contains(lw, 'the') THEN {_swapped_sql('the', 'this', False)} WHEN list_contains(lw, 'of') THEN {_swapped_sql('of', 'from', False)} END AS synonym,
  ['{"', '".join(_DETAILS)}'][(floor(('0x' || md5(item_id || ':front')[1:8])::BIGINT / 4294967296::DOUBLE * 3) + 1)::INT] || ' ' || text AS detail,
  CASE WHEN list_contains(w, 'The') THEN {_swapped_sql('The', 'Thes', True)} WHEN list_contains(w, 'Thes') THEN {_swapped_sql('Thes', 'Then', True)} WHEN list_contains(w, 'Then') THEN {_swapped_sql('Then', 'The', True)} END AS renamed FROM l""")
def surface_texts(t):
    c = F.col("text")
    changed = perturb.with_detail(c, _DETAILS, F.col("item_id"))
    return t("benchmark").select("item_id", perturb.synonyms(c, {"the": "this", "of": "from"}).alias("synonym"), changed.alias("detail"), perturb.renamed(c, {"names": ["The", "Thes", "Then"]}).alias("renamed"))
