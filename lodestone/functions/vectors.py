"""Arrays of numbers as vectors; sums run in order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 1e-9) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + guard)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def unit(a: Column, guard: float = 1e-9) -> Column:
    n = norm(a) + guard
    return F.transform(a, lambda x: x.cast("double") / n)


def hashed_words(text: Column) -> Column:
    """array<double> of 16 numbers: how many words of a text begin with each hexadecimal digit by their MD5. A vector for texts that have no other."""
    digits = F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.substring(F.md5(w), 1, 1)), "")
    # One string of digits, worked out once: how much shorter it is without a digit is how often that stands there.
    of = lambda s: F.transform(F.split(F.lit("0123456789abcdef"), ""), lambda d: (F.octet_length(s) - F.octet_length(F.replace(s, d, F.lit("")))).cast("double"))
    return F.get(F.transform(F.array(digits), of), F.lit(0))
