"""Scalar functions of texts: Column in, Column out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Words between white space; 0 for empty texts and null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


#: Bytes of texts that a Python worker holds as strings at once; a longer text goes alone.
PORTION = 1 << 20


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of slices of an array of texts with at most PORTION bytes each, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(texts):
        end = max(at + 1, min(at + 1000, int(np.searchsorted(ends, done + PORTION, "right"))))
        yield at, end - at
        at, done = end, int(ends[end - 1])


def _normalised(texts: pa.Array, forms: pa.Array) -> pa.Array:
    out = []
    for at, size in portions(texts):
        pairs = zip(texts.slice(at, size).to_pylist(), forms.slice(at, size).to_pylist(), strict=True)
        out.append(pa.array([None if x is None else unicodedata.normalize(f, x) for x, f in pairs], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def unicode_normalise(text: Column, form: Column | str = "NFC") -> Column:
    """Unicode normalisation; texts that are all ASCII are left to the JVM."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    # Python functions run for every row, whatever the branch: what is left to the JVM goes as null.
    return F.when(ascii_only, text).otherwise(F.arrow_udf(_normalised, "string")(F.when(~ascii_only, text), F.lit(form) if isinstance(form, str) else form))


def clean_text(text: Column, normalise: bool = True) -> Column:
    """NFC, tags cut out, white space collapsed, ends trimmed."""
    text = unicode_normalise(text) if normalise else text
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\s+", " "))


def question_answer(question: Column, answer: Column) -> Column:
    """"QUESTION: ..." and, where there is one, a blank line and "ANSWER: ..."."""
    has = answer.isNotNull() & (answer != "")
    return F.when(has, F.concat(F.lit("QUESTION: "), question, F.lit("\n\nANSWER: "), answer)).otherwise(F.concat(F.lit("QUESTION: "), question))


def year_of(text: Column, default: int = 1990) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"((19|20)\d{2})", 1), F.lit("")).cast("int"), F.lit(default))


def century_of(year: Column) -> Column:
    return F.when(year < 2000, 20).otherwise(21)


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 12 hexadecimal digits of the MD5 of the parts joined by colons."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12))


def slug(text: Column, words: int = 4) -> Column:
    """The first words of a text, in lower case, letters only, joined by underscores."""
    letters = F.trim(F.regexp_replace(F.lower(text), r"[^a-z\s]", ""))
    return F.array_join(F.slice(F.filter(F.split(letters, r"\s+"), lambda w: w != ""), 1, words), "_")


def shorten(text: Column, most: int = 50, keep: int | None = None) -> Column:
    """Texts of over `most` characters: the first `keep` (three less than most by default), and dots."""
    keep = most - 3 if keep is None else keep
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def with_opener(text: Column, opener: str) -> Column:
    """The opener in front, unless the text begins with its first word (in any case)."""
    first = opener.split()[0].lower()
    return F.when(F.lower(F.ltrim(text)).startswith(first), text).otherwise(F.concat(F.lit(f"{opener}\n\n"), text))


def first_containing(text: Column, table: dict[str, str], default: str) -> Column:
    """The value of the first key that the text contains, case aside."""
    text = F.lower(text)
    return F.coalesce(*[F.when(F.contains(text, F.lit(k.lower())), F.lit(v)) for k, v in table.items()], F.lit(default))


def lookup(key: Column, table: dict, default) -> Column:
    """The value of a key in a small table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def confidence_weight(confidence: Column) -> Column:
    """high 2, medium 1, low 0.5; numbers of 0.8 or more 2, others 1."""
    number = F.expr("1") if confidence is None else confidence.try_cast("double")
    return F.when(F.lower(confidence) == "high", 2.0).when(F.lower(confidence) == "medium", 1.0).when(F.lower(confidence) == "low", 0.5).when(number >= 0.8, 2.0).otherwise(1.0)


def multi_hot(values: Column, domain: list[str]) -> Column:
    """0 or 1 for each member of the domain."""
    return F.array(*[F.coalesce(F.array_contains(values, d), F.lit(False)).cast("int") for d in domain])


def script_share(text: Column, first: str, last: str) -> Column:
    """Share of the characters from first to last (code points), 0 for empty texts."""
    inside = F.char_length(F.regexp_replace(text, f"[^{first}-{last}]", ""))
    return F.when(F.char_length(text) > 0, inside / F.char_length(text)).otherwise(0.0)


# What each language's normalisation drops, and what it folds into what.
_HEBREW = ("\\u0591-\\u05C7", "\u05da\u05dd\u05df\u05e3\u05e5", "\u05db\u05de\u05e0\u05e4\u05e6")
_ARABIC = ("\\u064B-\\u065F\\u0640", "\u0623\u0625\u0622\u0671\u0629\u0649", "\u0627\u0627\u0627\u0627\u0647\u064a")
_SANSKRIT = "\\u0951-\\u0954\\u0900-\\u0902"
_PALI = ("\u1e43\u1e45\u00f1\u1e6d\u1e0d\u1e47\u1e37\u0101\u012b\u016b", "mnntdnlaiu")


# Language -> form, what goes, and what is replaced by what.
_FOLDS = {
    "hebrew": ("NFKC", re.compile(f"[{_HEBREW[0]}]"), [*zip(*_HEBREW[1:], strict=True)]),
    "aramaic": ("NFKC", re.compile(f"[{_HEBREW[0]}]"), [*zip(*_HEBREW[1:], strict=True)]),
    "arabic": ("NFKC", re.compile(f"[{_ARABIC[0]}]"), [*zip(*_ARABIC[1:], strict=True)]),
    "classical_chinese": ("NFKC", None, []),
    "sanskrit": ("NFC", re.compile(f"[{_SANSKRIT}]"), []),
    "pali": ("NFC", None, [*zip(*_PALI, strict=True)]),
}


def normalised(text: str, language: str | None) -> str:
    """normalise() of one text, for Python functions that take it in anyway."""
    if language not in _FOLDS:
        return unicodedata.normalize("NFKC", text.lower())
    form, drop, pairs = _FOLDS[language]
    text = unicodedata.normalize(form, text)
    if language == "pali":
        text = text.lower()
    if drop:
        text = drop.sub("", text)
    for old, new in pairs:  # no new letter is an old one
        text = text.replace(old, new)
    return text


def normalise(text: Column, language: Column) -> Column:
    """Text made comparable by its language; others: NFKC of lower case."""
    cased = language.isin("hebrew", "aramaic", "arabic", "classical_chinese", "sanskrit", "pali")
    # One call of Python for all languages, so that a text goes there and back once.
    plain = unicode_normalise(F.when(cased, text).otherwise(F.lower(text)), F.when(language.isin("sanskrit", "pali"), "NFC").otherwise("NFKC"))

    def folded(drop: str, old: str = "", new: str = "") -> Column:
        out = F.regexp_replace(plain, f"[{drop}]", "")
        return F.translate(out, old, new) if old else out

    return (
        F.when(language.isin("hebrew", "aramaic"), folded(*_HEBREW))
        .when(language == "arabic", folded(*_ARABIC))
        .when(language == "sanskrit", folded(_SANSKRIT))
        .when(language == "pali", F.translate(F.lower(plain), *_PALI))
        .otherwise(plain)
    )
