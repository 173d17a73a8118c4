"""One row to many: nested texts, chunks, tags, verdicts."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _walk(value, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], str]]:
    if isinstance(value, list):
        for i, x in enumerate(value, 1):
            yield from _walk(x, (*path, i))
    elif isinstance(value, str):
        yield path, value


def _pair(a, b, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], str | None, str | None]]:
    if isinstance(a, list) and isinstance(b, list):
        for i, (x, y) in enumerate(zip(a, b), 1):
            yield from _pair(x, y, (*path, i))
    elif isinstance(a, list) or isinstance(b, list):
        # One side only is nested: it goes on alone.
        left = isinstance(a, list)
        for p, x in _walk(a if left else b, path):
            yield p, *((x, None) if left else (None, x))
    elif isinstance(a, str) or isinstance(b, str):
        yield path, a if isinstance(a, str) else None, b if isinstance(b, str) else None


def flatten_pairs(df: DataFrame, first: str, second: str, id_col: str) -> DataFrame:
    """Two columns of nested JSON lists of texts, walked side by side: id, path ("1.2.3"), first, second; lists of different lengths are cut to the shorter."""
    rows = df.select(F.col(id_col).alias("id"), F.col(first).alias("first"), F.col(second).alias("second"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = [
                (r.id, ".".join(map(str, p)), x, y)
                for r in batch.itertuples(index=False)
                for p, x, y in _pair(json.loads(r.first) if r.first else None, json.loads(r.second) if r.second else None)
            ]
            yield pd.DataFrame(out, columns=["id", "path", "first", "second"])

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, path string, first string, second string")


#: Keys of objects that texts are looked for under, in order.
KEYS = ("he", "text", "content")


def nested_texts(value, depth: int = 5, longer_than: int = 20, keys: tuple[str, ...] = KEYS) -> Iterator[str]:
    if isinstance(value, str):
        if len(value) > longer_than:
            yield value
    elif depth > 0 and isinstance(value, list):
        for x in value:
            yield from nested_texts(x, depth - 1, longer_than, keys)
    elif depth > 0 and isinstance(value, dict):
        for k in keys:
            if k in value:
                yield from nested_texts(value[k], depth - 1, longer_than, keys)


def collect_texts(df: DataFrame, json_col: str, id_col: str, keys: tuple[str, ...] = KEYS, depth: int = 5, longer_than: int = 20) -> DataFrame:
    """Texts anywhere in a JSON document, to a depth: id, ordinal, text. Of objects, the given keys are looked into, in order."""
    rows = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = [(r.id, i, x) for r in batch.itertuples(index=False) for i, x in enumerate(nested_texts(json.loads(r.json) if r.json else None, depth, longer_than, keys), 1)]
            yield pd.DataFrame(out, columns=["id", "ordinal", "text"])

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, ordinal bigint, text string")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def chunks(text: Column, size: int = 400, most: int | None = None, longer_than: int = 50) -> Column:
    """Words packed greedily: a chunk ends with the word that brings it to `size` characters; short chunks are left out.

    `most`: only the first so many chunks are looked at, short ones included (the reference: 500); all by default.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, w: Column) -> Column:
        joined = F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))
        full = F.char_length(joined) >= size
        return F.struct(F.when(full, F.array_append(s["done"], joined)).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    out = F.aggregate(words, empty, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.filter(out if most is None else F.slice(out, 1, most), lambda c: F.char_length(c) > longer_than)


def packed_paragraphs(text: Column, size: int = 1500) -> Column:
    """Paragraphs packed greedily below `size` characters; one that is longer stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        fits = F.char_length(s["open"]) + F.char_length(p) < size
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        done = F.when(fits | (s["open"] == ""), s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    return F.aggregate(paragraphs(text), empty, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def tags(language: Column, periods: Column, by_language: dict[str, list[str]], by_period: dict[str, list[str]]) -> Column:
    """Tags of a language and of all its periods, sorted, each once."""

    def table(t: dict[str, list[str]]) -> Column:
        return F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def of(t: Column, key: Column) -> Column:
        return F.coalesce(F.try_element_at(t, key), F.array().cast("array<string>"))

    own = of(table(by_language), language)
    return F.array_sort(F.array_distinct(F.concat(own, F.flatten(F.transform(periods, lambda p: of(table(by_period), p))))))


def expanded_tags(df: DataFrame, groups: dict[str, list[str]], tag_col: str = "tag") -> DataFrame:
    """One row per member of a tag that names a group, the tag itself otherwise; groups aren't looked into again."""
    members = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return df.withColumn(tag_col, F.explode(F.coalesce(F.try_element_at(members, F.col(tag_col)), F.array(F.col(tag_col)))))
