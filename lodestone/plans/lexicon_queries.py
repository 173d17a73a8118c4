"""Queries of the lexicons in files and of the pattern automaton.

The synthetic tables hold neither the scripts nor, but by chance, the words of the lexicons. Texts are therefore rendered first: letters are replaced by those of a script (RENDERED), with a word of
the script's lexicon before and behind (seeds), or frequent words by words of the English lexicons (WORDED), in Spark and in SQL alike. Every text of the table is used, whole.
"""

from __future__ import annotations

import importlib.util
import re
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.operators import automaton as A
from lodestone.plans.registry import query
from lodestone.sources import lexicons as X

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters of each script that take the place of a to z.
RENDERED = {
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשתאבגד",
    "aramaic": "אבגדהוזחטיכלמנסעפצקרשתאבגד",
    "classical_chinese": "天地山水火木金土日月星風雨雷不可殺財仁石禾必約王勿父",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنه",
    "english": LATIN,
    "sanskrit": "ाधचदेपगहिजकलमन्पषरसतुवअचयऋ",
    "pali": LATIN,
}
#: Words of the tables that words of the English lexicons take the place of, one after the other.
WORDED = [(" the ", " my promise "), (" of ", " must help "), (" and ", " honor a parent "), (" to ", " agree with the judge "), (" in ", " return it "), (" con ", " refuse the king "), (" und ", " some say save a life ")]

_NOT_WORD = r"[^\p{L}\p{N}_]"


def re2(pattern: str, doubled: bool = False) -> str:
    """A pattern for DuckDB, whose \\b knows ASCII letters only: boundaries are spelled out, and gaps stay in their line. doubled: for texts in which each character that isn't part of a word stands twice."""
    inner = r"[^\p{L}\p{N}_\n]"
    head, *rest = pattern.split(".*")
    parts = [head, *rest]
    out = []
    for i, p in enumerate(parts):
        if doubled:
            p = re.sub(r"(?<=\w)([ '-])(?=[\w\\(])", r"\1\1", p)
        if p.startswith("\\b"):
            p = (f"(?:^|{_NOT_WORD})" if i == 0 and not doubled else _NOT_WORD if i == 0 else inner) + p[2:]
        if p.endswith("\\b"):
            p = p[:-2] + (_NOT_WORD if doubled and i == len(parts) - 1 else f"(?:$|{_NOT_WORD})" if i == len(parts) - 1 else inner)
        out.append(p.replace(r"\w", r"[\p{L}\p{N}_]"))
    return "[^\\n]*".join(out).replace("'", "''")


def seeds(rows: list[tuple], language: str) -> list[str]:
    """A text that each pattern of a language matches, as (language, kind, class, class_ordinal, ordinal, pattern) rows have them."""
    return [re.sub(r"\[(.).*?\]", r"\1", r[5].replace("\\b", "").replace(".*", " x ").replace(".", "-")) for r in rows if r[0] == language]


def rendered(text: Column, language: Column, number: Column, rows: list[tuple]) -> Column:
    out = F.lit(None).cast("string")
    for name, letters in RENDERED.items():
        words = F.array(*map(F.lit, seeds(rows, name)))
        before, behind = F.get(words, F.pmod(F.floor(number / len(RENDERED)), F.size(words)).cast("int")), F.get(words, F.pmod(number * 31, F.size(words)).cast("int"))
        out = F.when(language == name, F.concat(before, F.lit(" "), F.translate(F.lower(text), LATIN, letters), F.lit(" "), behind)).otherwise(out)
    return out


def language_of(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, X.LANGUAGES)), F.pmod(number, F.lit(len(X.LANGUAGES))).cast("int"))


def shipped_rows() -> list[tuple]:
    return [r for n in X.LANGUAGES for r in X._loaded(resources.files("lodestone.lexicons").joinpath(f"{n}.yaml").read_text("utf-8"))]


def _matched(t, spark):
    docs = t("documents").select("doc_id", language_of(F.col("doc_id")).alias("language"), "text")
    text = rendered(F.col("text"), F.col("language"), F.col("doc_id"), shipped_rows())
    return docs.select("doc_id", "language", A.lexicon_matches(X.loaded(X.shipped(spark)), text, F.col("language"), T.normalised).alias("matches"))


def _lexicon_sql() -> tuple[str, str]:
    """(bonds of each text, hits of each pattern) in SQL, from the shipped files."""
    rows = shipped_rows()
    names = "[" + ", ".join(f"'{n}'" for n in X.LANGUAGES) + "]"
    words = {n: [w.replace("'", "''") for w in seeds(rows, n)] for n in X.LANGUAGES}
    lists = {n: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for n, ws in words.items()}
    letters = " ".join(f"WHEN '{n}' THEN {lists[n]}[doc_id // {len(RENDERED)} % {len(words[n])} + 1] || ' ' || translate(lower(text), '{LATIN}', '{x}') || ' ' || {lists[n]}[doc_id * 31 % {len(words[n])} + 1]" for n, x in RENDERED.items())
    finals = "translate(r, 'ךםןףץ', 'כמנפצ')"
    base = f"""base AS (
  SELECT doc_id, language, CASE language WHEN 'pali' THEN translate(r, 'ṃṅñṭḍṇḷāīū', 'mnntdnlaiu') WHEN 'hebrew' THEN {finals} WHEN 'aramaic' THEN {finals}
    WHEN 'arabic' THEN translate(r, 'ةى', 'هي') WHEN 'sanskrit' THEN regexp_replace(r, '[\\x{{0900}}-\\x{{0902}}]', '', 'g') ELSE r END AS text FROM (
    SELECT doc_id, language, CASE language {letters} END AS r FROM (SELECT doc_id, text, {names}[doc_id % {len(X.LANGUAGES)} + 1] AS language FROM documents))
)"""

    def tests(kind: str) -> str:
        """Per language, a list of {class, pattern} that match, in order of precedence."""
        by = []
        for n in X.LANGUAGES:
            items = ", ".join(f"CASE WHEN regexp_matches(text, '{re2(p)}') THEN {{'c': '{c}', 'p': '{p.replace(chr(39), chr(39) * 2)}'}} END" for lang, k, c, _, _, p in rows if lang == n and k == kind)
            by.append(f"WHEN '{n}' THEN list_filter([{items}], lambda x: x IS NOT NULL)" if items else f"WHEN '{n}' THEN []")
        return f"CASE language {' '.join(by)} END"

    matched = f"""matched AS (
  SELECT doc_id, language, {tests('bond')} AS bond, {tests('hohfeld')} AS state, {tests('negation')} AS negation, {tests('modal')} AS modal FROM base
)"""
    distinct = "list_filter(list_transform(bond, lambda x: x.c), lambda c, i: i = 1 OR c <> bond[i - 1].c)"
    bonds = f"""
WITH {base}, {matched}
SELECT doc_id, language, coalesce(bond[1].c, 'NONE') AS bond, array_to_string({distinct}, ',') AS bonds, state[1].c AS state, len(negation) > 0 AS negated,
  modal[1].c AS modal_class, round(CASE WHEN len(bond) > 0 THEN 0.9 ELSE 0.5 END::DOUBLE * CASE WHEN len(negation) > 0 THEN 0.8 ELSE 1 END::DOUBLE, 9) AS confidence
FROM matched"""
    hits = f"""
WITH {base}, {matched}, firsts AS (
  SELECT language, unnest(list_filter(bond, lambda x, i: i = 1 OR x.c <> bond[i - 1].c)) AS h FROM matched
)
SELECT language, h.c AS class, h.p AS pattern, count(*) AS n FROM firsts GROUP BY ALL"""
    return bonds, hits


if importlib.util.find_spec("yaml"):
    _BONDS, _HITS = _lexicon_sql()

    @query("RUL8 RUL9 RUL10 RUL13 RUL26 FLT6", _BONDS)
    def lexicon_bonds(t):
        m = _matched(t, t("documents").sparkSession)
        c = F.col("matches")
        found, no = A.classes(c, "bond"), F.size(A.of_kind(c, "negation")) > 0
        confidence = F.when(F.size(found) > 0, 0.9).otherwise(0.5) * F.when(no, 0.8).otherwise(1.0)
        return m.select(
            "doc_id", "language", A.first(c, "bond", "NONE").alias("bond"), F.array_join(found, ",").alias("bonds"), A.first(c, "hohfeld").alias("state"), no.alias("negated"),
            A.first(c, "modal").alias("modal_class"), F.round(confidence, 9).alias("confidence"),
        )

    @query("RUL14 RUL26 AG2 AG3", _HITS)
    def lexicon_pattern_hits(t):
        hits = _matched(t, t("documents").sparkSession).select("language", F.explode(A.first_patterns(F.col("matches"), "bond")).alias("h"))
        return hits.groupBy("language", F.col("h.class").alias("class"), F.col("h.pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def worded(text: Column) -> Column:
    for old, new in WORDED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _bond_sql() -> str:
    text = "text"
    for old, new in WORDED:
        text = f"replace({text}, '{old}', '{new}')"
    doubled = f"'  ' || regexp_replace(lower({text}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || '  '"
    count = lambda ps: " + ".join(f"len(regexp_extract_all(t, '{re2(p.lower(), True)}'))" for p in ps)
    any_of = lambda ps: " OR ".join(f"regexp_matches(t, '{re2(p.lower(), True)}')" for p in ps)
    roles = ", ".join(f"CASE WHEN {any_of(ps)} THEN '{c}' END" for c, ps in L.ROLES.items())
    relations = ", ".join(f"{{'m': -({count(ps)}), 'o': {i}, 'c': '{c}'}}" for i, (c, ps) in enumerate(L.RELATIONS.items()))
    consent = " ".join(f"WHEN {any_of(ps)} THEN '{c}'" for c, ps in L.CONSENT.items())
    return f"""
WITH d AS (SELECT doc_id, {doubled} AS t FROM documents), f AS (
  SELECT doc_id, list_sort(list_filter([{roles}], lambda x: x IS NOT NULL)) AS found,
         list_transform(list_sort(list_filter([{relations}], lambda x: x.m < 0)), lambda x: x.c) AS counted, CASE {consent} ELSE 'IMPLICIT_YES' END AS consent FROM d
), g AS (
  SELECT doc_id, CASE WHEN len(found) > 0 THEN found ELSE ['OTHER', 'SELF'] END AS roles, CASE WHEN len(counted) > 0 THEN counted ELSE ['CARE'] END AS relations, consent FROM f
), b AS (
  SELECT doc_id, r, a, p, consent FROM (SELECT doc_id, roles, consent, unnest(relations[1:3]) AS r FROM g) x, unnest(roles) AS u(a), unnest(roles) AS v(p) WHERE a <> p OR r IN ('AUTONOMY', 'CARE')
), o AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r, a, p) AS n FROM b
), named AS (
  SELECT doc_id, role, 'R' || row_number() OVER (PARTITION BY doc_id ORDER BY min(place)) - 1 AS name FROM (SELECT doc_id, a AS role, 2 * n AS place FROM o UNION ALL SELECT doc_id, p, 2 * n + 1 FROM o) GROUP BY doc_id, role
), s AS (
  SELECT o.doc_id, count(*) AS n, string_agg(x.name || '-' || y.name || ':' || r || '/' || consent, '|' ORDER BY x.name, y.name, r) AS signature
  FROM o JOIN named x ON o.doc_id = x.doc_id AND o.a = x.role JOIN named y ON o.doc_id = y.doc_id AND o.p = y.role GROUP BY o.doc_id
)
SELECT g.doc_id, array_to_string(roles, ',') AS roles, array_to_string(relations, ',') AS relations, consent, coalesce(n, 0) AS n_bonds, coalesce(signature, 'empty') AS signature FROM g LEFT JOIN s ON g.doc_id = s.doc_id"""


@query("RUL1 RUL2 RUL4 RUL5 RUL6", _bond_sql())
def bond_signatures(t):
    """Roles, relations by their counts, consent, bonds and canonical signature of each text."""
    lexicons = [("role", L.ROLES), ("relation", L.RELATIONS), ("consent", L.CONSENT)]
    patterns = [r for kind, lexicon in lexicons for r in X.declared(kind, {c: [p.lower() for p in ps] for c, ps in lexicon.items()})]
    m = A.match_lexicon(t("documents"), patterns, ["doc_id"], F.lower(worded(F.col("text"))))
    c = F.col("matches")
    roles = F.array_sort(A.classes(c, "role"))
    found = m.select(
        "doc_id", F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("OTHER"), F.lit("SELF"))).alias("roles"), A.ranked(c, "relation", [*L.RELATIONS], "CARE").alias("relations"), A.first(c, "consent", "IMPLICIT_YES").alias("consent")
    )
    # Worked out once: expressions above an explode are not inlined.
    rows = found.select("doc_id", "roles", "relations", "consent", F.explode(F.array(R.bonds(F.col("roles"), F.col("relations"), F.col("consent")))).alias("bonds"))
    return rows.select("doc_id", F.array_join("roles", ",").alias("roles"), F.array_join("relations", ",").alias("relations"), "consent", F.size("bonds").cast("long").alias("n_bonds"), R.signature(F.col("bonds")).alias("signature"))
