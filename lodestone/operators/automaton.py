"""All patterns of a lexicon in one pass over a text: an Aho-Corasick automaton for each language.

A pattern is cut into choices of literal text, single characters and gaps ("a(b|c)d", "a.b", "[ab]c", "a.*b", with word boundaries). The longest literal of
what lies before the first gap is a key of the automaton; where it is found, boundaries are looked at, and single characters and gaps are confirmed by the regular expression at that place.
Of a pattern with a gap only the first occurrence in a line is tried: if what follows isn't found after it, it isn't after a later one. Patterns of other forms are searched for
as regular expressions, in texts that hold their longest literal.

Texts go through in Arrow batches, of which a worker takes a portion at a time; the automaton is built once a Python worker, from the patterns, which are a program and small.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rules import let
from lodestone.functions.text import portions

MATCH = "struct<kind: string, class: string, pattern: string, n: int, at: int>"
#: More choices than this make a pattern one of the other forms.
MOST_CHOICES = 200
_SPECIAL = set(r"\.[]()*+?{}|^$")
#: What is asked for most among what isn't part of a word.
_NO_WORD = set(" .,;:!?-'\"()\n\t")


@dataclass(frozen=True)
class Form:
    """A way in which a pattern matches: its key, how far the key lies behind its beginning, and what is left to confirm."""

    key: str
    offset: int
    length: int  # of the whole, where there is no gap; else 0
    left: bool
    right: bool
    confirm: re.Pattern | None  # with a gap: what lies before it
    gap: bool


def _choices(p: str) -> list[str] | None:
    """The pattern with each "(a|b)" replaced by its choices, in order; None where groups are nested or repeated."""
    parts: list[list[str]] = []
    for i, x in enumerate(re.split(r"\(([^()]*)\)", p)):
        if i % 2:
            parts.append(x.split("|"))
        elif set("()|") & set(re.sub(r"\\.", "", x)) or x[:1] in ("*", "+", "?", "{"):
            return None
        else:
            parts.append([x])
    out = ["".join(c) for c in product(*parts)]
    return out if len(out) <= MOST_CHOICES else None


def _items(p: str) -> list[str] | None:
    """Characters, "." and "[...]" one by one, "\\b" and ".*"; None for anything else."""
    out, i = [], 0
    while i < len(p):
        if p.startswith("\\b", i) or p.startswith(".*", i):
            out.append(p[i : i + 2])
            i += 2
        elif p[i] == "\\":
            if i + 1 == len(p) or p[i + 1].isalnum():
                return None
            out.append(p[i + 1])
            i += 2
        elif p[i] == "[":
            end = p.find("]", i + 2)
            if end < 0:
                return None
            out.append(p[i : end + 1])
            i = end + 1
        elif p[i] in _SPECIAL - {"."}:
            return None
        else:
            out.append("any" if p[i] == "." else p[i])
            i += 1
    for a, b in zip(out, [*out[1:], ""], strict=True):
        if b in ("*", "+", "?", "{"):
            return None
    return out


def _form(p: str) -> Form | None:
    items = _items(p)
    if items is None:
        return None
    gap = ".*" in items
    head = items[: items.index(".*")] if gap else items
    left = head[:1] == ["\\b"]
    right = not gap and len(head) > 1 and head[-1] == "\\b"
    head = head[left : len(head) - right]
    inner = "\\b" in head
    head = [x for x in head if x != "\\b"]
    runs, begin = [], 0
    for i in range(len(head) + 1):
        if i == len(head) or len(head[i]) > 1:
            runs.append((i - begin, -begin))
            begin = i + 1
    size, at = max(runs, default=(0, 0))
    if not size:
        return None
    plain = size == len(head) and not gap and not inner
    return Form("".join(head[-at : -at + size]), -at, 0 if gap else len(head), left, right, None if plain else re.compile(p.partition(".*")[0]), gap)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _boundary(text: str, i: int) -> bool:
    return (i > 0 and _word(text[i - 1])) != (i < len(text) and _word(text[i]))


class Patterns:
    """The patterns of one language: matches(text) gives the number of matches of each that has any, as regular expressions count them."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.other: list[tuple[int, re.Pattern, str]] = []
        self.whole: dict[int, re.Pattern] = {}
        keys: dict[str, list[tuple]] = {}
        for n, p in enumerate(patterns):
            choices = _choices(p)
            forms = [_form(c) for c in choices] if choices else [None]
            if any(f is None for f in forms):
                literal = max(re.findall(r"(?<![\\(|])[^\W\d_]{2,}(?![?*+{|)])", re.sub(r"\([^()]*\)|\[[^\]]*\][?*+]?|\\.|.[?*]", " ", p)), key=len, default="")
                self.other.append((n, re.compile(p), literal))
                continue
            self.whole[n] = re.compile(p)
            for k, f in enumerate(forms):
                keys.setdefault(f.key, []).append((n, k, f.offset, f.length, self._left(f), f.right, f.confirm, f.gap))
        self.automaton = ahocorasick.Automaton()
        for key, found in keys.items():
            self.automaton.add_word(key, (len(key), found))
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    @staticmethod
    def _left(f: Form) -> int:
        """0: no boundary before it; 1: one before a key that begins with a character of words, so what stands before it decides; 2: another."""
        return 0 if not f.left else 1 if not f.offset and _word(f.key[0]) else 2

    def _spans(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """Pattern -> (begin, choice, end) of its occurrences; with a gap, one a line and choice."""
        spans: dict[int, list[tuple[int, int, int]]] = {}
        tried: dict[tuple[int, int], int] = {}
        size = len(text)
        for last, (length, found) in self.automaton.iter(text):
            at = last - length + 1
            free = not at or text[at - 1] in _NO_WORD or not _word(text[at - 1])
            for n, k, offset, whole, left, right, confirm, gap in found:
                begin = at - offset
                if left and not (free if left == 1 else begin >= 0 and _boundary(text, begin)):
                    continue
                if gap:
                    if begin < tried.get((n, k), 0) or begin < 0 or not confirm.match(text, begin):
                        continue
                    line = text.find("\n", begin)
                    tried[n, k] = size + 1 if line < 0 else line
                    m = self.whole[n].match(text, begin)
                    if m is None:
                        continue
                    end = m.end()
                else:
                    end = begin + whole
                    if begin < 0 or end > size or (right and not _boundary(text, end)) or (confirm and not confirm.match(text, begin)):
                        continue
                spans.setdefault(n, []).append((begin, k, end))
        return spans

    def found(self, text: str) -> dict[int, tuple[int, int]]:
        """Pattern -> the number of its matches, and where the first one begins (from 0)."""
        out = {}
        for n, spans in ({} if self.empty else self._spans(text)).items():
            if len(spans) == 1:
                out[n] = 1, spans[0][0]
                continue
            spans.sort()
            count, free = 0, 0
            for begin, _, end in spans:
                if begin >= free:
                    count, free = count + 1, end
            out[n] = count, spans[0][0]
        for n, p, literal in self.other:
            if literal in text and (begins := [m.start() for m in p.finditer(text)]):
                out[n] = len(begins), begins[0]
        return out

    def matches(self, text: str) -> dict[int, int]:
        return {n: count for n, (count, _) in self.found(text).items()}


def _finder(patterns: list[tuple[str, str, str, str]], by_language: bool, prepared: Callable[[str, str | None], str] | None = None) -> Callable[[pa.Array, pa.Array | None], pa.Array]:
    """The matches of each of some texts, with the languages of these; prepared: what makes of a text and its language the text that is matched."""
    built: dict[str, tuple[Patterns, list]] = {}

    def of(language: str | None) -> tuple[Patterns, list]:
        if language not in built:
            own = [r[1:] for r in patterns if not by_language or r[0] == language]
            built[language] = (Patterns([r[2] for r in own]), own)
        return built[language]

    def find(texts: pa.Array, names: pa.Array | None) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("class", pa.string()), ("pattern", pa.string()), ("n", pa.int32()), ("at", pa.int32())]))
        languages = {r[0] for r in patterns}
        out = []
        for text, name in zip(texts.to_pylist(), [None] * len(texts) if names is None else names.to_pylist(), strict=True):
            if text is None or (by_language and name not in languages):
                out.append([])
                continue
            automaton, own = of(name if by_language else None)
            found = automaton.found(prepared(text, name) if prepared else text)
            out.append([{"kind": own[i][0], "class": own[i][1], "pattern": own[i][2], "n": found[i][0], "at": found[i][1]} for i in sorted(found)])
        return pa.array(out, kind)

    return find


def _matched(patterns: list[tuple[str, str, str, str]], language_at: int | None, text_at: int):
    find = _finder(patterns, language_at is not None)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(*part) for b in batches for part in portions(b.column(text_at))):
            found = find(batch.column(text_at), None if language_at is None else batch.column(language_at))
            columns = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, found], [*[n for i, n in enumerate(batch.schema.names) if i != text_at], "matches"])

    return run


def lexicon_matches(patterns: list[tuple[str, str, str, str]], text: Column, language: Column, prepared: Callable[[str, str | None], str] | None = None) -> Column:
    """The matches of match_lexicon as a Column. prepared: what makes of a text and its language the text that is matched, in the same call of Python, so that
    one worker a core sees the texts and none goes back."""
    find = _finder(patterns, True, prepared)

    def run(texts: pa.Array, names: pa.Array) -> pa.Array:
        parts = [find(texts.slice(*part), names.slice(*part)) for part in portions(texts)]
        return pa.concat_arrays(parts) if parts else find(texts, names)

    return F.arrow_udf(run, f"array<{MATCH}>")(text, language)


def match_lexicon(df: DataFrame, patterns: list[tuple[str, str, str, str]], keep: list[str], text: Column, language: str | None = None) -> DataFrame:
    """keep, and matches: array<struct<kind, class, pattern, n, at>> of all patterns that match a text, in order of precedence, with their numbers of matches and where the first one begins (from 0).

    patterns: (language, kind, class, pattern), as lodestone.sources.lexicons gives them. language: the column of keep that chooses the patterns; a null one or one without
    patterns has no matches. Without a column all patterns hold. Texts are matched as they are: lower-case or normalise them first. A null text matches nothing.
    """
    rows = df.select(*keep, text.alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    at = rows.columns.index(language) if language else None
    return rows.mapInArrow(_matched(patterns, at, len(keep)), f"{schema}, matches array<{MATCH}>")


def of_kind(matches: Column, kind: str) -> Column:
    return F.filter(matches, lambda m: m["kind"] == kind)


def classes(matches: Column, kind: str, default: str | None = None) -> Column:
    """All classes that match, in order of precedence; the default alone where there is none."""
    found = F.array_distinct(F.transform(of_kind(matches, kind), lambda m: m["class"]))
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def first(matches: Column, kind: str, default: str | None = None) -> Column:
    """The first class that matches."""
    return F.coalesce(F.get(classes(matches, kind), F.lit(0)), F.lit(default))


def first_patterns(matches: Column, kind: str) -> Column:
    """array<struct<class, pattern>>: of each class that matches, its first pattern that does."""
    own = of_kind(matches, kind)
    pairs = F.transform(own, lambda m, i: F.when((i == 0) | (F.get(own, i - 1)["class"] != m["class"]), F.struct(m["class"].alias("class"), m["pattern"].alias("pattern"))))
    return F.filter(pairs, lambda x: x.isNotNull())


def ranked(matches: Column, kind: str, order: list[str], default: str | None = None) -> Column:
    """Classes by their numbers of matches, most first, then in the order given."""

    def item(own: Column, i: int, c: str) -> Column:
        n = F.aggregate(F.filter(own, lambda m: m["class"] == c), F.lit(0), lambda a, m: a + m["n"])
        return F.struct((-n).alias("minus"), F.lit(i).alias("ordinal"), F.lit(c).alias("class"))

    items = let(of_kind(matches, kind), lambda own: F.array(*[item(own, i, c) for i, c in enumerate(order)]))
    names = F.transform(F.array_sort(F.filter(items, lambda x: x["minus"] < 0)), lambda x: x["class"])
    return names if default is None else let(names, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default))))
