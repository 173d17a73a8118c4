"""Texts as flat arrays: Arrow buffers, word boundaries and hashes of spans, all in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes worked on at a time; a longer text makes a piece of its own.
PIECE = 1 << 21
_SEED = np.random.default_rng(20240229)
#: A random odd base, its inverse modulo 2**64, and a random number for each byte.
_BASE = int(_SEED.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space, as [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
        if size > PIECE * 4:  # not kept: one very long text
            return _powers.pop(base)[:n]
    return _powers[base][:n]


def trimmed(run):
    """run, giving free memory back to the system when a task ends: workers live on, and each keeps what it has not given back."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """h[i]: hash of the symbols (random 64-bit numbers) before i."""
    h = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power(_BASE, len(symbols)), out=h[1:])
    return h


def span_hash(h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span that depends on its symbols only; lengths are to be told apart by the caller, or through mix()."""
    return (h[ends] - h[begins]) * _power(_INVERSE, len(h))[begins]


#: Longer spans are hashed by xxhash.
_LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The lowest 0 to 8 bytes of a number.
_LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hash(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans that stand for them: eight bytes at a time go through mix(), so no structure of the bytes survives. Spans of up to eight bytes never collide with others as long."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    size = ends - begins
    h = mix(size.astype(np.uint64) * _STEP)
    for i in range(0, min(int(size.max(initial=0)), _LONG), 8):
        on = np.flatnonzero(size > i) if i else slice(None)
        h[on] = mix(h[on] * _STEP + (eight[begins[on] + i] & _LOWEST[np.minimum(size[on] - i, 8)]))
    for k in np.flatnonzero(size > _LONG):
        h[k] = xxhash.xxh3_64_intdigest(data[begins[k] : ends[k]].tobytes())
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(kind)
    if texts.null_count:
        texts = texts.fill_null(b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of some `most` bytes together: (first row, row after the last)."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words (no white space inside, none across rows), and how many each row has before it: rows + 1 numbers."""
    white = WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = ~white
    begin[1:] &= white[:-1] | edge[1:-1]
    begins = np.flatnonzero(begin)
    end = ~white
    end[:-1] &= white[1:] | edge[1:-1]
    ends = np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, offsets)
