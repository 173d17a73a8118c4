"""Reactions of readers: follow-ups of some letters, and counts of engagement, drawn by hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.perturb import chance, chosen

SHARE = 0.3


def between(draw: Column, low: Column | int, high: Column | int) -> Column:
    """A whole number from low to high, by a number from 0 to below 1."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.floor(draw * (high - low + 1))).cast("long")


def follow_up(key: Column, verdicts: Column, outcomes: dict[str, list[str]], share: float = SHARE) -> Column:
    """struct<outcome, satisfaction> for a share of the letters, null for the others.

    verdicts: array<struct<state, expected>>; where every one is as expected, or nothing is, the writer is grateful, else neutral; outcomes has the texts of both.
    """
    pleased = F.forall(verdicts, lambda v: v["expected"].isNull() | (v["state"] == v["expected"]))
    text = lambda mood: chosen(F.array(*map(F.lit, outcomes[mood])), chance(key, "outcome"))
    mood = lambda name: F.struct(text(name).alias("outcome"), F.lit(name).alias("satisfaction"))
    return F.when(chance(key, "follow-up") < share, F.when(pleased, mood("grateful")).otherwise(mood("neutral")))


def engagement(key: Column) -> Column:
    """struct<comments, shares, saves>: 200 to 2000 comments, shares from half to three times as many, 50 to 500 saves."""
    comments = between(chance(key, "comments"), 200, 2000)
    shares = between(chance(key, "shares"), F.floor(comments / 2), comments * 3)
    return F.struct(comments.alias("comments"), shares.alias("shares"), between(chance(key, "saves"), 50, 500).alias("saves"))
