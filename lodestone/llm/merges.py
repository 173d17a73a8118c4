"""Byte-pair merges of many words at once (operators 5 and 8): the best pair of each word, the leftmost of equals, until none is left.

A word is a row of symbols. All words of one length make a matrix; each word that goes on loses one symbol a step, so the matrix stays one, and words
of that length join it. So a step costs a few array operations for all words together, and there are as many steps as the longest word has symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The rank of a pair that is never merged.
NONE = np.iinfo(np.int32).max
_FREE = np.iinfo(np.uint64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the texts whose new words are merged together.
PORTION = 1 << 22


def portions(texts: list[str]) -> Iterator[list[str]]:
    """Texts with up to PORTION characters together, or one text."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > PORTION:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def gathered(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of an array, one after the other."""
    ends = np.cumsum(counts)
    return pool[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class Merges:
    """Pairs of symbols with their ranks, the best one lowest, and what becomes of each pair.

    left, right, rank, made: one item a pair, no pair twice. Symbols and ranks are numbers from 0 to below 2^31; ranks have no large gaps.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks, self.results = np.full(1 << bits, _FREE), np.full(1 << bits, NONE, np.int32), np.full(1 << bits, -1, np.int32)
        keys, rank, made = self._key(np.asarray(left), np.asarray(right)), np.asarray(rank, np.int32), np.asarray(made, np.int32)
        # What each rank makes; -1 where its pairs make different symbols.
        self.made = np.full(rank.max(initial=0) + 1, -1, np.int32)
        self.made[rank] = made
        self.made[rank[self.made[rank] != made]] = -1
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == _FREE)
            self.keys[at[free]] = keys[free]
            there = self.keys[at] == keys
            self.ranks[at[there]], self.results[at[there]] = rank[there], made[there]
            keys, rank, made, at = keys[~there], rank[~there], made[~there], (at[~there] + 1) & self.last

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _STEP) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair."""
        return self._found(left, right, self.ranks, NONE)

    def _found(self, left: np.ndarray, right: np.ndarray, values: np.ndarray, none: int) -> np.ndarray:
        keys = self._key(left, right).ravel()
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, values[at], none)
        rest = np.flatnonzero((held != keys) & (held != _FREE))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.last
            held = self.keys[at]
            own = held == keys[rest]
            out[rest[own]] = values[at[own]]
            on = ~own & (held != _FREE)
            rest, at = rest[on], at[on]
        return out.reshape(left.shape)

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words, one word after the other, and how many each has left; sizes: how many each had, one at least."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(sizes.max(initial=0) + 2))
        word = np.zeros(0, np.int64)
        now, rank = np.zeros((0, len(bounds) - 1), np.int32), np.zeros((0, len(bounds) - 2), np.int32)
        done = []
        for width in range(len(bounds) - 2, 0, -1):
            now, rank = now.reshape(-1, width), rank.reshape(len(now), width - 1)
            new = order[bounds[width] : bounds[width + 1]]
            if len(new):
                fresh = symbols[starts[new][:, None] + np.arange(width)]
                word, now, rank = np.concatenate([word, new]), np.concatenate([now, fresh]), np.concatenate([rank, self.rank(fresh[:, :-1], fresh[:, 1:])])
            if width == 1:
                break
            best = rank.argmin(1)
            low = rank[np.arange(len(word)), best]
            on = low != NONE
            if not on.all():
                done.append((word[~on], now[~on]))
                word, now, rank, best, low = word[on], now[on], rank[on], best[on], low[on]
            now, rank = self._step(now, rank, best, low)
        done.append((word, now))
        counts = np.zeros(len(sizes), np.int64)
        for own, rows in done:
            counts[own] = rows.shape[1]
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        for own, rows in done:
            out[(ends - counts)[own][:, None] + np.arange(rows.shape[1])] = rows
        return out, counts

    def _step(self, now: np.ndarray, rank: np.ndarray, best: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One pair of each word merged: its left symbol becomes the new one, its right symbol goes."""
        (n, width), each = now.shape, np.arange(len(now))
        stays, paired = np.ones(now.shape, bool), np.ones(rank.shape, bool)
        stays[each, best + 1] = False
        paired[each, best] = False
        made = self.made[low]
        if len(tied := np.flatnonzero(made < 0)):
            made[tied] = self._found(now[tied, best[tied]], now[tied, best[tied] + 1], self.results, -1)
        now[each, best] = made
        now, rank = now[stays].reshape(n, width - 1), rank[paired].reshape(n, width - 2)
        before, behind = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
        i, j = best[before], best[behind]
        rank[before, i - 1] = self.rank(now[before, i - 1], now[before, i])
        rank[behind, j] = self.rank(now[behind, j], now[behind, j + 1])
        return now, rank
