"""Functions for SQL: register(spark) makes them known to a session. Table functions turn a JSON text into rows and are joined laterally.

    SELECT id, f.* FROM texts, LATERAL flatten_pairs(hebrew, english) f

JSON that can't be parsed gives no rows, like a null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators.flatten import _pair, nested_texts


def _parsed(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


class FlattenPairs:
    """Two nested lists of texts side by side: path ("1.2.3"), first, second. Lists are cut to the shorter; where one side only is a list, it goes on alone."""

    def eval(self, first: str, second: str) -> Iterator[tuple]:
        for path, a, b in _pair(_parsed(first), _parsed(second)):
            yield ".".join(map(str, path)), a, b


class FlattenJson:
    """Everything in a JSON text that isn't a list or an object: path (keys and numbers from 1, by full stops), kind, value as text; empty lists and objects have no rows."""

    def eval(self, text: str) -> Iterator[tuple]:
        def walk(x, path: str) -> Iterator[tuple]:
            if isinstance(x, dict | list):
                for k, v in x.items() if isinstance(x, dict) else enumerate(x, 1):
                    yield from walk(v, f"{path}.{k}" if path else str(k))
            elif x is not None:
                kind = "boolean" if isinstance(x, bool) else "text" if isinstance(x, str) else "number"
                yield path, kind, x if isinstance(x, str) else json.dumps(x)

        yield from walk(_parsed(text), "")


class CollectTexts:
    """Texts longer than so many characters anywhere in a JSON document down to a depth, of objects under the keys he, text and content: ordinal, text."""

    def eval(self, text: str, depth: int, longer_than: int) -> Iterator[tuple]:
        yield from enumerate(nested_texts(_parsed(text), depth, longer_than), 1)


TABLE_FUNCTIONS = {
    "flatten_pairs": (FlattenPairs, "path string, first string, second string"),
    "flatten_json": (FlattenJson, "path string, kind string, value string"),
    "collect_texts": (CollectTexts, "ordinal int, text string"),
}

#: Scalar functions in SQL: name, arguments, type, body.
SCALAR_FUNCTIONS = [
    ("word_count", "text STRING", "INT", r"size(filter(split(text, '\\s+'), w -> w <> ''))"),
    ("content_id", "prefix STRING, source STRING, ref STRING, text STRING", "STRING", "concat(prefix, '_', substring(md5(concat_ws(':', source, ref, substring(text, 1, 50))), 1, 12))"),
    ("bond_index", "defects BIGINT, verdicts BIGINT, tau DOUBLE", "DOUBLE", "CASE WHEN verdicts > 0 THEN defects / verdicts / tau ELSE 0.0D END"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, replacing those of the same name; their names."""
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
    for name, arguments, kind, body in SCALAR_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [*TABLE_FUNCTIONS, *[f[0] for f in SCALAR_FUNCTIONS]]
