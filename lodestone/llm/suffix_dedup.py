"""Suffix-array deduplication (operator 1): every byte that a repeated string of `width` bytes covers goes.

The suffix array is sparse. Each window of `width` bytes has an anchor: of the K-byte strings inside, the leftmost with the
smallest hash. Equal windows have equal anchors at equal offsets, so all repeats are found
among suffixes that begin at anchors, about one byte in seventy. Consecutive windows of one anchor are a run.

1. Runs are dealt by the hash of their anchor (frequent anchors: by the run). Runs that are equal as a whole are repeats at once; anchors that
   occur once drop out. Of the rest, one run of each kind goes on.
2. Sampled splitters range-partition these suffixes by their leading bytes. A bucket sorts the windows
   of its suffixes by multikey quicksort (leading token, then the fingerprint of the rest: only equality
   is asked, not the order beyond) and compares neighbours byte by byte. Equal leading bytes never part, so no repeat crosses a boundary,
   but for an anchor with very many different runs: its windows are dealt one by one, by fingerprint, which parts equal ones never.
3. Spans are gathered by document, united, and cut out.

Texts travel compressed. A document is named by a 64-bit hash of its id and text; should two share it,
runs are told apart by comparing them with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import byte_arrays as ba
from lodestone.session import materialize

#: Bytes of an anchor.
K = 64
#: Leading bytes by which suffixes are partitioned.
LEAD = 16
#: An anchor with more different runs than this is dealt window by window.
HOT = 20_000
#: Runs that a bucket works on at a time, at least; rows held back of one anchor, at most.
CHUNK, HELD = 8_000, 200_000
#: Runs of one anchor in a piece of text from which they are dealt by the run.
KINDS = 8
#: Starts in a piece: positions take the low 22 bits.
PIECE = 1 << 21
_POSITION = np.uint64((1 << 22) - 1)
_PACK = 1024


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of some documents laid end to end: document, begin, end (of the last window), anchor; and the prefix hash of data."""
    h = ba.prefix_hash(ba.BYTE[data])
    empty = np.zeros(0, np.int64)
    if len(data) < width:
        return empty, empty, empty, empty, h
    grams = np.arange(len(data) - K + 1)
    value = ba.mix(ba.span_hash(h, grams, grams + K)) & ~_POSITION | grams.astype(np.uint64)
    least = _sliding_min(value, width - K + 1)
    starts = len(least)
    anchor = (least & _POSITION).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    valid = np.arange(starts) + width <= offsets[1:][doc]
    change = np.ones(starts, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], starts) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return doc[first], first, last + width, anchor[first], h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i, by blocks of w."""
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    head = np.minimum.accumulate(grid, 1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    n = len(x) - w + 1
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def run_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Names of runs: XXH3 of their bytes, with the length and the place of the anchor. Together with the anchor's own hash 128 bits tell runs apart."""
    view, name = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    found = np.fromiter((name(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))
    return ba.mix(found + ba.mix(((end - begin) * _PACK + anchor - begin).astype(np.uint64) + np.uint64(1)))


def _pieces(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, document after the last, begin, end) of pieces; a long document is cut into overlapping ones."""
    for a, b in ba.pieces(offsets, PIECE):
        begin, end = int(offsets[a]), int(offsets[b])
        if end - begin <= PIECE + width:
            yield a, b, begin, end
            continue
        for at in range(begin, end, PIECE):
            if at == begin or end - at >= width:
                yield a, b, at, min(end, at + PIECE + width - 1)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: the order of rows by their tokens. Three parts around a pivot token; the middle one goes on with the next token."""
    out = np.empty(len(tokens[0]), np.int64)
    stack = [(np.arange(len(out)), 0, 0)]
    while stack:
        ids, depth, at = stack.pop()
        if len(ids) <= 4096 or depth == len(tokens):
            out[at : at + len(ids)] = ids[np.lexsort([t[ids] for t in reversed(tokens[depth:])])] if depth < len(tokens) else ids
            continue
        token = tokens[depth][ids]
        pivot = np.partition(token[:: max(1, len(token) // 255)], len(token[:: max(1, len(token) // 255)]) // 2)[len(token[:: max(1, len(token) // 255)]) // 2]
        low, same = token < pivot, token == pivot
        n_low, n_same = int(low.sum()), int(same.sum())
        stack += [(ids[low], depth, at), (ids[same], depth + 1, at + n_low), (ids[~low & ~same], depth, at + n_low + n_same)]
    return out


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as a number in the bytes' order."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | data[at + i]
    return out


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some runs: run, place in data, fingerprint."""
    counts = np.diff(offsets) - width + 1
    run = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(run)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + offsets[:-1][run]
    return run, at, ba.mix(ba.span_hash(ba.prefix_hash(ba.BYTE[data]), at, at + width))


def repeated(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """For each run, the begin of its first repeated window and the end of its last one (-1, -1: none), both in the run."""
    run, at, print_ = _windows(data, offsets, width)
    order = multikey_order([_words(data, at), print_])
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(print_[a] == print_[b])
    a, b = a[near], b[near]
    same = np.ones(len(a), bool)
    for i in range(0, width, 8):
        step = min(i, width - 8)
        same &= _words(data, at[a] + step) == _words(data, at[b] + step)
    hit = np.zeros(len(run), bool)
    hit[a[same]] = hit[b[same]] = True
    out = np.full((len(offsets) - 1, 2), -1, np.int64)
    found = np.flatnonzero(hit)
    if len(found):
        runs, first = np.unique(run[found], return_index=True)
        last = np.append(first[1:], len(found)) - 1
        out[runs, 0] = at[found[first]] - offsets[:-1][runs]
        out[runs, 1] = at[found[last]] - offsets[:-1][runs] + width
    return out


# Stages


#: Names that two different rows share, at most; at 10**10 rows some three are to be expected.
MOST_CLASHES = 10_000


def _names(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), id_col, text_col)]


def _clashes(df: DataFrame, id_col: str, text_col: str) -> list[int]:
    """64-bit names of rows that differ in their other 64 bits: as good as none, so they fit into an expression."""
    first, second = _names(id_col, text_col)
    both = df.select(first.alias("n"), second.alias("m")).groupBy("n").agg(F.min("m").alias("low"), F.max("m").alias("high")).where("low <> high")
    found = both.select("n").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise ValueError(f"more than {MOST_CLASHES} names of rows clash")
    return [r.n for r in found]


def _named(df: DataFrame, id_col: str, text_col: str, clashes: list[int]) -> DataFrame:
    """df with __rid, a name for each row by 64 bits of its id and text, or by 64 others where rows that differ share the first ones. Rows that are equal in both share a name."""
    first, second = _names(id_col, text_col)
    return df.withColumn("__rid", F.when(first.isin(clashes), second).otherwise(first) if clashes else first)


def _runs(width: int):
    """Runs of the documents: deal, pk (hash of the anchor), rkey, rid, begin, shape (length x 1024 + offset of the anchor).

    A task sends at most two equal runs; more of them are repeats already, and are sent as spans (shape: minus the length), dealt by document.
    Runs are dealt by their anchor. Where one anchor has more than KINDS of them in a piece of text, these
    are dealt by the run instead, and a row of shape 0 tells the anchor's own place that there are others.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # run keys sent once, and twice
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = ba.flat(batch.column(1))
            for a, b, begin, end in _pieces(offsets, width):
                own = np.clip(offsets[a : b + 1], begin, end) - begin
                doc, first, last, anchor, h = anchors(data[begin:end], own, width)
                if not len(doc):
                    continue
                key = run_keys(data[begin:end], first, last, anchor)
                order = np.argsort(key, kind="stable")
                rank = np.empty(len(key), np.int64)
                head = np.ones(len(key), bool)
                head[1:] = key[order][1:] != key[order][:-1]
                rank[order] = np.arange(len(key)) - np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
                seen = np.isin(key, known[0]).astype(np.int64) + np.isin(key, known[1])
                extra = rank + seen >= 2
                known[1] = np.union1d(known[1], key[~extra & (rank + seen == 1)])
                known[0] = np.union1d(known[0], key[rank == 0])
                if len(known[0]) > 1_000_000:
                    known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
                pk = ba.mix(ba.span_hash(h, anchor, anchor + K))
                place = first + begin - offsets[:-1][a:b][doc]
                shape = (last - first) * _PACK + anchor - first
                size = last - first
                # Anchors that are known to have several runs need not wait for the rest in one place.
                found, which, counts = np.unique(pk, return_inverse=True, return_counts=True)
                hot = counts > KINDS
                deal = np.where(hot[which] & ~extra, ba.mix(pk ^ key), pk)
                told = found[hot]
                # Neighbouring spans become one.
                e = np.flatnonzero(extra)
                if len(e):
                    new = np.ones(len(e), bool)
                    new[1:] = (doc[e][1:] != doc[e][:-1]) | (e[1:] != e[:-1] + 1)
                    i = np.flatnonzero(new)
                    j = np.append(i[1:], len(e)) - 1
                    size[e[i]] = last[e[j]] - first[e[i]]
                    shape[e[i]] = -size[e[i]]
                    deal[e[i]] = pk[e[i]] = ba.mix(rid[a:b][doc[e[i]]].view(np.uint64))
                    key[e[i]] = 0
                    keep = ~extra
                    keep[e[i]] = True
                else:
                    keep = ~extra
                zero = np.zeros(len(told), np.int64)
                columns = [deal[keep].view(np.int64), pk[keep].view(np.int64), key[keep].view(np.int64), rid[a:b][doc[keep]], place[keep], shape[keep]]
                columns = [np.concatenate([c, t]) for c, t in zip(columns, [told.view(np.int64), told.view(np.int64), zero, zero, zero, zero], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.int32()] * 2, strict=True)], ["deal", "pk", "rkey", "rid", "begin", "shape"])

    return run


_JUDGED = "rid bigint, begin int, shape int, pk bigint, rkey bigint, send boolean, span boolean"


def _judge(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor and run key: spans of repeats (span), and one run of each kind where an anchor has several (send)."""
    names = ["deal", "pk", "rkey", "rid", "begin", "shape"]

    forced: int | None = None

    def judged(x: dict[str, np.ndarray], force: bool) -> pa.RecordBatch | None:
        free, told = x["shape"] < 0, x["shape"] == 0
        anchor = np.ones(len(free), bool)
        anchor[1:] = (x["deal"][1:] != x["deal"][:-1]) | (x["pk"][1:] != x["pk"][:-1])
        kind = anchor.copy()
        kind[1:] |= (x["rkey"][1:] != x["rkey"][:-1]) | (np.sign(x["shape"][1:]) != np.sign(x["shape"][:-1]))
        kind_of = np.cumsum(kind) - 1
        many = (np.bincount(kind_of) > 1)[kind_of] & ~told
        anchor_of = np.cumsum(anchor) - 1
        kinds = np.bincount(anchor_of, (kind & ~free) + 2 * told)[anchor_of]
        span = free | many
        send = kind & ~free & ~told & ((kinds > 1) | force | (x["deal"] != x["pk"]) | (False if forced is None else x["pk"] == forced))
        keep = span | send
        if not keep.any():
            return None
        columns = [x[n][keep] for n in ("rid", "begin", "shape", "pk", "rkey")]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(send[keep]), pa.array(span[keep])], ["rid", "begin", "shape", "pk", "rkey", "send", "span"])

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if held is not None:
            x = {n: np.concatenate([held[n], x[n]]) for n in names}
        if not len(x["pk"]):
            continue
        cut = int(np.searchsorted(x["deal"], x["deal"][-1], "left"))
        force = len(x["pk"]) - cut > most
        if force:
            # Too many runs of one anchor to wait for its end: they are taken to be of several kinds, which is safe.
            change = (x["rkey"][1:] != x["rkey"][:-1]) | (x["pk"][1:] != x["pk"][:-1])
            cut = max(cut, int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0)
        if cut and (out := judged({n: x[n][:cut] for n in names}, force)) is not None:
            yield out
        if force:
            forced = int(x["pk"][-1])  # what is left of this anchor is sent, be it one kind
        held = {n: x[n][cut:] for n in names}
    if held is not None and len(held["pk"]) and (out := judged(held, True)) is not None:
        yield out


def _packed(df: DataFrame, text_col: str) -> DataFrame:
    """df with the text as zstd-compressed bytes in __z, and the others as they are."""
    fields = [f for f in df.schema.fields if f.name != text_col]
    at = df.columns.index(text_col)

    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                z = pa.array([c.compress((x or "").encode()) for x in part.column(at).to_pylist()], pa.binary())
                rest = [part.column(k) for k in range(part.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*rest, z], [*(f.name for f in fields), "__z"])

    return df.mapInArrow(ba.trimmed(run), T.StructType([*fields, T.StructField("__z", T.BinaryType())]))


def _cut_out(width: int):
    """Run records of documents: lead, pk, rid, begin, span, bytes. A run that isn't in the text is another document's."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[tuple] = []
                for rid, z, sends in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    text = d.decompress(z)
                    for s in sends:
                        size, offset = divmod(s["shape"], _PACK)
                        part = text[s["begin"] : s["begin"] + size]
                        if len(part) == size:
                            out.append((part[offset : offset + LEAD], s["pk"], s["rkey"], rid, s["begin"], offset, s["span"], part))
                if not out:
                    continue
                data, offsets = ba.flat(pa.array([o[-1] for o in out], pa.large_binary()))
                begin = offsets[:-1]
                key = run_keys(data, begin, offsets[1:], begin + np.array([o[5] for o in out]))
                own = key.view(np.int64) == np.array([o[2] for o in out])
                columns = list(zip(*[o for o, k in zip(out, own, strict=True) if k], strict=True))
                if columns:
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in zip((0, 1, 3, 4, 6, 7), kinds, strict=True)], ["lead", "pk", "rid", "begin", "span", "bytes"])

    return run


def _sorted_buckets(width: int):
    """Buckets sorted by leading bytes and anchor: spans of the runs that aren't repeats as a whole."""

    def spans(table: pa.Table) -> pa.RecordBatch | None:
        data, offsets = ba.flat(table.column("bytes"))
        found = repeated(data, offsets, width)
        new = (found[:, 0] >= 0) & ~table.column("span").to_numpy()
        if not new.any():
            return None
        begin = table.column("begin").to_numpy()[new].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(table.column("rid").to_numpy()[new]), pa.array(begin + found[new, 0]), pa.array(begin + found[new, 1])], ["rid", "b", "e"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < CHUNK:
                continue
            key = held.column("pk").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if not len(change):
                continue
            # Whole anchors only; what is left waits for the next batch.
            cuts, at = [], 0
            while len(c := change[change >= at + CHUNK - 1]):
                cuts.append(int(c[0]) + 1)
                at = cuts[-1]
            at = 0
            for cut in cuts:
                if (out := spans(held.slice(at, cut - at).combine_chunks())) is not None:
                    yield out
                at = cut
            held = held.slice(at).combine_chunks()
        if held is not None and held.num_rows and (out := spans(held.combine_chunks())) is not None:
            yield out

    return run


def _dealt_windows(width: int):
    """Windows of runs: f1, f2 (128 bits), rid, begin, span."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                data, offsets = ba.flat(part.column("bytes"))
                counts = np.diff(offsets) - width + 1
                run = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][run]
                view, name = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
                names = np.frombuffer(b"".join([name(view[x : x + width]) for x in place.tolist()]), np.int64).reshape(-1, 2)
                f1, f2 = np.ascontiguousarray(names[:, 0]), np.ascontiguousarray(names[:, 1])
                begin = part.column("begin").to_numpy()[run] + place - offsets[:-1][run]
                span = part.column("span").to_numpy(zero_copy_only=False)[run]
                yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), pa.array(part.column("rid").to_numpy()[run]), pa.array(begin, pa.int64()), pa.array(span)], ["f1", "f2", "rid", "begin", "span"])

    return run


def repeat_spans(df: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", name: str = "suffix", hot: int = HOT, clashes: list[int] | None = None) -> DataFrame:
    """Spans of repeated bytes: rid (hash of id and text), b, e; they may overlap. clashes: names that stand for several rows, found anew by default."""
    clashes = _clashes(df, id_col, text_col) if clashes is None else clashes
    base = _named(df.select(id_col, text_col), id_col, text_col, clashes).select("__rid", text_col)
    runs = base.mapInArrow(ba.trimmed(_runs(width)), "deal bigint, pk bigint, rkey bigint, rid bigint, begin int, shape int")
    judged = materialize(runs.repartition("deal").sortWithinPartitions("deal", "pk", "rkey").mapInArrow(ba.trimmed(partial(_judge, most=HELD)), _JUDGED), f"{name}-judged")
    length = F.when(F.col("shape") < 0, -F.col("shape")).otherwise(F.floor(F.col("shape") / _PACK))
    whole = judged.where("span").select("rid", F.col("begin").cast("long").alias("b"), (F.col("begin") + length).cast("long").alias("e"))
    sends = judged.where("send").groupBy("rid").agg(F.collect_list(F.struct("begin", "shape", "pk", "rkey", "span")).alias("sends"))
    texts = _packed(base, text_col)
    # The smaller side by far; Spark decides by its size whether to broadcast it.
    joined = texts.join(sends, F.col("__rid") == F.col("rid")).select("rid", "__z", "sends")
    records = joined.mapInArrow(ba.trimmed(_cut_out(width)), "lead binary, pk bigint, rid bigint, begin int, span boolean, bytes binary")
    crowded = judged.where("send").groupBy("pk").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select(F.col("pk").alias("crowd"))
    records = materialize(records.join(crowded, F.col("pk") == F.col("crowd"), "left").withColumn("hot", F.col("crowd").isNotNull()).drop("crowd"), f"{name}-records")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = records.where("NOT hot").drop("hot").repartitionByRange(n, "lead", "pk").sortWithinPartitions("lead", "pk")
    found = buckets.mapInArrow(ba.trimmed(_sorted_buckets(width)), "rid bigint, b bigint, e bigint")
    windows = records.where("hot").drop("hot").mapInArrow(ba.trimmed(_dealt_windows(width)), "f1 bigint, f2 bigint, rid bigint, begin bigint, span boolean")
    twice = windows.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    hits = windows.where("NOT span").join(twice, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left_semi")
    return whole.union(found).union(hits.select("rid", F.col("begin").alias("b"), (F.col("begin") + width).alias("e")))


def _united(spans: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted((s["b"], s["e"]) for s in spans or ()):
        e = min(e, size)
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        elif b < e:
            out.append((b, e))
    return out


def _applied(df: DataFrame, width: int, id_col: str, text_col: str, name: str, hot: int, added: list[tuple[str, pa.DataType, T.DataType]], row, only: list[str] | None = None) -> DataFrame:
    """df with its text replaced by what row(bytes, spans) returns; null texts count as empty."""
    clashes = _clashes(df, id_col, text_col)
    spans = repeat_spans(df, width, id_col, text_col, name, hot, clashes).groupBy(F.col("rid").alias("__r")).agg(F.collect_list(F.struct("b", "e")).alias("__spans"))
    base = _named(df if only is None else df.select(*only, text_col), id_col, text_col, clashes)
    joined = _packed(base, text_col).join(spans, F.col("__rid") == F.col("__r"), "left").drop("__r", "__rid")
    kept = [f for f in joined.schema.fields if f.name not in ("__z", "__spans")]

    def run(batches):
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = []
                for z, s in zip(part.column("__z").to_pylist(), part.column("__spans").to_pylist(), strict=True):
                    text = d.decompress(z)
                    found.append(row(text, _united(s, len(text))))
                new = [pa.array([f[i] for f in found], kind) for i, (_, kind, _) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new], [*(f.name for f in kept), *(n for n, _, _ in added)])

    return joined.mapInArrow(ba.trimmed(run), T.StructType([*kept, *(T.StructField(n, t) for n, _, t in added)]))


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    bounds = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def suffix_dedup(df: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", name: str = "suffix", hot: int = HOT) -> DataFrame:
    """df with the repeated bytes of the text gone; all rows and all other columns stay.

    A byte goes if a string of `width` bytes (65 to 500) that covers it starts anywhere else too, in the same document or another one,
    overlaps included; strings are judged on the input. An empty table gives no rows; texts of any length are read in pieces. Texts are UTF-8; characters of which only some bytes go lose the others too.
    Null texts count as empty, and stay null. Rows may repeat ids, or each other (then they are copies), and ids may be null.
    """
    columns = df.columns
    out = _applied(df.withColumn("__null", F.col(text_col).isNull()), width, id_col, text_col, name, hot, [(text_col, pa.string(), T.StringType())], lambda text, spans: (_rest(text, spans).decode(errors="ignore"),))
    return out.withColumn(text_col, F.when(~F.col("__null"), F.col(text_col))).select(*columns)


def suffix_digests(df: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", name: str = "suffix", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, of what suffix_dedup() takes away."""

    def row(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(text), sum(e - b for b, e in spans), len(spans), hashlib.sha256(_rest(text, spans)).hexdigest()

    long, string = (pa.int64(), T.LongType()), (pa.string(), T.StringType())
    added = [("n_bytes", *long), ("n_removed", *long), ("n_spans", *long), ("kept_sha256", *string)]
    return _applied(df, width, id_col, text_col, name, hot, added, row, [id_col]).withColumnRenamed(id_col, "doc_id")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200)
