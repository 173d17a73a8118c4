"""Packing (operator 5): lexical retrieval packing.

Documents are tokenised and ranked by BM25 over token ids. The inverted index is sharded: documents whose heaviest terms (by BM25, over the statistics of the
whole corpus) are the same share a shard. In a shard the longest unused document is the seed of a window; the index returns its unused neighbours,
best first, which fill the window; the last one is cut, and its rest is unused again. So windows are full, but for the last one of a shard, which is cut into
sequences of powers of two.

A document is dealt by its leading terms: those that at least one other document has, heaviest first. First terms that few documents lead with go to one
shard together, up to SHARD tokens; a first term with more is divided by the terms that come next, so copies and near copies stay together. Only documents that agree in all of these
and are more than a shard together are dealt by a hash. A corpus of up to SHARD tokens is one shard. What goes to the driver are two numbers for each id of the vocabulary.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_arrays as ba
from lodestone.llm import merges
from lodestone.session import materialize

WINDOW = 4096
END = 2
#: Tokens of a shard.
SHARD = 1 << 20
#: Parts of one first term from which two more terms deal its documents, not one.
FINE = 2048
K1, B = 1.2, 0.75
CACHE_ENTRIES = 400_000
#: Of these, those that stay when a task ends.
KEPT = 60_000
#: Characters of the longest chunk whose words are merged together with those of others.
LONGEST = 64
#: Texts are cut at these: white space for any tokenizer that this module accepts.
_CHUNK = re.compile(r"[^ \n\t\r]+")


# The normaliser and the split of a tokenizer whose words can be told without it.
_NORMAL = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same split for texts of printable ASCII and Latin letters, in lower case; all of these are in NFC, and their lower case too (that of İ is not among them).
_SIMPLE = re.compile("[\n\t\r -~À-ÖØ-öø-įı-ſ]*")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: The kind of each byte of such texts, whose only white space is the blank: the bytes of letters outside ASCII are from 128 on.
_KINDS = np.array([_SPACE if b == 32 else _DIGIT if chr(b).isdigit() else _LETTER if b >= 128 or chr(b).isalpha() else _SIGN for b in range(128)] + [_LETTER] * 128, np.uint8)


def _word_begins(data: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of such a text: a flag for each byte."""
    kinds = _KINDS[data]
    before = np.append(np.uint8(_SPACE), kinds[:-1])
    begins = (kinds != _SPACE) & ((kinds != before) | (kinds == _DIGIT))
    # An apostrophe that doesn't continue a run of signs takes the letters of 's and the like with it.
    at = np.flatnonzero(begins & (data == ord("'")))
    first, second = (np.append(data, np.zeros(2, np.uint8))[at + i] for i in (1, 2))
    two = ((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l")))
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    at, size = at[one | two], np.where(one, 2, 3)[one | two]
    begins[at + 1] = False
    at = (at + size)[at + size < len(data)]
    begins[at] = kinds[at] != _SPACE
    return begins


def _byte_letters() -> list[str]:
    """The printable character for each byte in byte-level BPE: itself where it is one, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class ChunkIds:
    """Chunks of texts that are known, and the token ids of each; when full, the chunks that came first stay.

    Chunks lie between white space. Where the tokenizer is of the kind above, the words of simple chunks go to its merges without its other steps,
    those of all new chunks together.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        probe = "a\n\t b"
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != [i for c in "ab" for i in self.tokenizer.encode(c, add_special_tokens=False).ids]:
            raise ValueError("only tokenizers that drop white space and never join what it parts")
        spec = json.loads(tokenizer)
        steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [(x["type"], x.get("pattern", {}).get("Regex")) for x in splits]
        self.words = steps == _NORMAL and kinds == [("Split", _SPLIT), ("ByteLevel", None)] and spec["model"]["type"] == "BPE" and not splits[1]["add_prefix_space"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.merges = self._merges(spec["model"]) if self.words else None
        self.known = pa.array([], pa.string())
        self.starts, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _merges(self, model: dict) -> merges.Merges | None:
        """The merges of the model, where it has no other steps and every byte has an id; else None."""
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            return None
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        made = [a + b for a, b in pairs]
        if any(c not in ids or c + suffix not in ids for c in self.letters) or len({*map(tuple, pairs)}) < len(pairs):
            return None
        # The ids of each byte, inside a word and at its end.
        self.inner, self.final = (np.array([ids[c + x] for c in self.letters], np.int32) for x in ("", suffix))
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        return merges.Merges(left, right, np.arange(len(pairs)), np.array([ids[x] for x in made]))

    def __len__(self) -> int:
        return len(self.known)

    def _simple(self, text: str) -> bool:
        return bool(self.merges and _SIMPLE.fullmatch(text)) and text == text.lower() and not any(s in text for s in self.special)

    def _learn(self, new: pa.StringArray) -> None:
        """Adds new chunks and their ids, in their order."""
        joined = _joined(new)
        simple = np.full(len(new), True) if self._simple(joined.as_py()) else np.fromiter(map(self._simple, new.to_pylist()), bool, len(new))
        simple &= pc.utf8_length(new).to_numpy() <= LONGEST
        counts, ids = np.zeros(len(new), np.int64), np.zeros(0, self.dtype)
        if simple.any():
            data = np.frombuffer((joined if simple.all() else _joined(new.filter(pa.array(simple)))).as_buffer(), np.uint8)
            blank = data == 32
            chunk_ends = np.append(np.flatnonzero(blank), len(data)) - np.arange(simple.sum())
            symbols = data[~blank]
            word_ends = np.append(np.flatnonzero(_word_begins(data)[~blank]), len(symbols))
            merged, left = self._merged(symbols, word_ends)
            ids = merged.astype(self.dtype)
            counts[simple] = np.diff(np.cumsum(np.append(0, left))[np.searchsorted(word_ends, chunk_ends)], prepend=0)
        if not simple.all():
            rest = np.flatnonzero(~simple)
            own = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in new.take(pa.array(rest)).to_pylist()]
            at = (np.cumsum(counts) - counts)[rest]
            counts[rest] = [*map(len, own)]
            ids = np.insert(ids, np.repeat(at, counts[rest]), np.array([*chain.from_iterable(own)], self.dtype))
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.pool = np.concatenate([self.pool, ids])

    def _merged(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as bytes and where each begins and ends, and how many each has."""
        ids, last = self.inner[symbols], ends[1:] - 1
        ids[last] = self.final[symbols[last]]
        return self.merges.merged(ids, np.diff(ends))

    def shrink(self, most: int) -> None:
        """Leaves the chunks that came first, which are the common ones."""
        if len(self) > most:
            self.known = self.known.take(pa.array(np.arange(most)))
            self.starts, self.counts = self.starts[:most].copy(), self.counts[:most].copy()
            self.pool = self.pool[: int(self.counts.sum())].copy()

    def _encoded(self, lists: pa.ListArray) -> Iterator[np.ndarray]:
        """The ids of each list of chunks."""
        if len(self) >= CACHE_ENTRIES:
            self.shrink(KEPT)
        coded = lists.flatten().dictionary_encode()
        # Arrow looks all chunks up at once, without a Python string for each.
        numbers = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self) + np.arange(len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
        numbers = numbers[coded.indices.to_numpy()]
        counts = self.counts[numbers]
        ids = merges.gathered(self.pool, self.starts[numbers], counts)
        bounds = np.cumsum(np.append(0, counts))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        yield from (ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False))

    def ids(self, texts: list[str], end: int | None) -> list[np.ndarray]:
        last, out = np.array([] if end is None else [end], self.dtype), []
        for part in merges.portions(texts):
            whole = pa.array(part, pa.string())
            simple = np.array([bool(self.words and _SIMPLE.fullmatch(t) and not any(s in t for s in self.special)) for t in part])
            found = np.empty(len(part), object)
            for own, cut in ((np.flatnonzero(simple), self._split), (np.flatnonzero(~simple), self._cut)):
                for i, ids in zip(own.tolist(), self._encoded(cut(whole.take(pa.array(own)))) if len(own) else (), strict=True):
                    found[i] = np.concatenate([ids, last])
            out += found.tolist()
        return out

    @staticmethod
    def _split(texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(pc.utf8_lower(texts))

    @staticmethod
    def _cut(texts: pa.Array) -> pa.ListArray:
        return pa.array(map(_CHUNK.findall, texts.to_pylist()), pa.list_(pa.string()))


def _joined(chunks: pa.StringArray) -> pa.StringScalar:
    """Chunks with a blank between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), " ")[0]


_TOKENIZERS: dict[str, ChunkIds] = {}


def _tokenizer(source: str) -> ChunkIds:
    if source not in _TOKENIZERS:
        _TOKENIZERS[source] = ChunkIds(source)
    return _TOKENIZERS[source]


def _tokenized(shared, end: int):
    """Rows of documents (row, a number of its own; key, doc_id, n, z), and at the end of a task one row with the frequencies of its ids (n is null)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        packer = zstandard.ZstdCompressor(level=3)
        frequency = np.zeros(max(tokenizer.size, end + 1), np.int64)
        names = ["row", "key", "doc_id", "n", "z"]
        kind, row = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            kind = batch.schema.field(1).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = tokenizer.ids([x or "" for x in part.column(2).to_pylist()], end)
                for ids in found:
                    frequency[ids] += 1  # an id that comes more than once counts once
                at_row = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([at_row, part.column(0), part.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([packer.compress(x.tobytes()) for x in found], pa.binary())], names)
        tokenizer.shrink(KEPT)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], kind), pa.array([None], pa.int64()), pa.array([packer.compress(frequency.tobytes())], pa.binary())], names)

    return run


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        for z in batch.column(0).to_pylist():
            f = np.frombuffer(d.decompress(z), np.int64)
            ids = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(f[ids])], ["id", "f"])


def _weights(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1)))


def portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of documents with up to SHARD tokens together and 2^16 in number, or one document."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        end = max(at + 1, min(at + (1 << 16), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD, "right"))))
        yield at, end
        at = end


def counted(docs: list[np.ndarray], by_term: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, number) for all different ids of each document, in the order of documents and ids, or of ids and documents. One sort of all, of the narrowest numbers that hold both."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    doc = np.repeat(np.arange(len(docs)), [*map(len, docs)])
    kind = np.dtype(np.uint32 if ids.dtype.itemsize == 2 and len(docs) <= 1 << 16 else np.uint64)
    half, low = kind.type(kind.itemsize * 4), (1 << kind.itemsize * 4) - 1
    high, rest = (ids, doc) if by_term else (doc, ids)
    keys = (high.astype(kind) << half) | rest.astype(kind)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    number, keys = np.diff(first, append=len(keys)), keys[first]
    a, b = (keys >> half).astype(np.int64), (keys & kind.type(low)).astype(np.int64)
    return (b, a, number) if by_term else (a, b, number)


def leading_terms(docs: list[np.ndarray], idf: np.ndarray, mean: float, shared: np.ndarray) -> np.ndarray:
    """The three heaviest terms of each document, of the shared ones, the smaller id of equals first; -1 where there is none."""
    out = np.full((len(docs), 3), -1, np.int64)
    for begin, end in portions(np.array([*map(len, docs)], np.int64)):
        doc, term, tf = counted(docs[begin:end])
        on = shared[term]
        doc, term, tf = doc[on], term[on], tf[on]
        weight = _weights(idf[term], tf, np.array([*map(len, docs[begin:end])], np.int64)[doc], mean)
        for k in range(3):
            if not len(doc):
                break
            # The heaviest one of each document that has any left, and the first of equals.
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            most = np.repeat(np.maximum.reduceat(weight, starts), np.diff(starts, append=len(doc)))
            at = np.flatnonzero(weight == most)
            at = at[np.append(True, doc[at[1:]] != doc[at[:-1]])]
            out[begin + doc[at], k] = term[at]
            left = np.ones(len(doc), bool)
            left[at] = False
            doc, term, weight = doc[left], term[left], weight[left]
    return out


class Dealing:
    """Where documents go: first terms with the tokens that they lead, to groups of up to `most` tokens, or to several parts of one."""

    def __init__(self, term: np.ndarray, tokens: np.ndarray, most: int):
        self.group: dict[int, tuple[int, int]] = {}
        number, filled = 0, 0
        for t, n in sorted(zip(term.tolist(), tokens.tolist(), strict=True)):
            if filled and filled + n > most:
                number, filled = number + 1, 0
            parts = -(-n // most)
            self.group[t] = (number, parts)
            if parts > 1:
                number, filled = number + parts, 0
            else:
                filled += n

    def shard(self, leads: np.ndarray) -> np.ndarray:
        group = np.array([self.group[t] for t in leads[:, 0].tolist()], np.int64).reshape(-1, 2)
        step = np.uint64(0x9E3779B97F4A7C15)
        key = ba.mix(leads[:, 1].astype(np.uint64) * step)
        key = np.where(group[:, 1] >= FINE, ba.mix(key + leads[:, 2].astype(np.uint64)), key)
        return group[:, 0] + (key % group[:, 1].astype(np.uint64)).astype(np.int64)


def _leads(stats, dtype: str):
    """Rows (n, z) of documents: n, and the leading terms."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        idf, mean, shared = stats.value
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            docs = [np.frombuffer(d.decompress(z), dtype) for z in batch.column("z").to_pylist()]
            found = leading_terms(docs, idf, mean, shared)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), *(pa.array(found[:, i]) for i in range(3))], ["row", "n", "a", "b", "c"])

    return run


def _sharded(dealing):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = np.stack([batch.column(c).to_numpy() for c in ("a", "b", "c")], 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(dealing.value.shard(leads))], ["r", "n", "shard"])

    return run


class Shard:
    """Documents of a shard and their inverted index."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
        self.docs, self.window = docs, window
        self.start = np.array([len(d) // window * window for d in docs], np.int64)  # whole windows are cut off in front
        self.length = np.array([len(d) for d in docs], np.int64)
        self.doc, term, tf = counted(docs, by_term=True)
        self.weight = _weights(idf[term], tf, self.length[self.doc], mean)
        self.bounds = np.searchsorted(term, np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents of the shard for the ids of the seed."""
        terms = counted([self.docs[seed]])[1]
        begin, sizes = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[at], self.weight[at], len(self.docs))

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences, as lists of (document, start, length)."""
        for i, whole in enumerate(self.start):
            for at in range(0, int(whole), self.window):
                yield [(i, at, self.window)]
        left = self.length - self.start
        for seed in np.argsort(-left, kind="stable"):
            while left[seed]:
                filled, out = 0, []
                for i in self._neighbours(int(seed), left):
                    take = int(min(left[i], self.window - filled))
                    out.append((int(i), int(self.start[i]), take))
                    self.start[i] += take
                    left[i] -= take
                    filled += take
                    if filled == self.window:
                        break
                if filled == self.window:
                    yield out
                else:
                    yield from _powers_of_two(out, filled)

    def _neighbours(self, seed: int, left: np.ndarray) -> Iterator[int]:
        yield seed
        if left[seed] == 0 and not left.any():
            return
        scores = self.scores(seed)
        rest = np.flatnonzero(left)
        rest = rest[rest != seed]
        yield from rest[np.argsort(-scores[rest], kind="stable")]


def _powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """What is left, cut into sequences whose lengths are powers of two."""
    pieces = list(reversed(pieces))
    while total:
        room, out = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            i, at, n = pieces.pop()
            take = min(n, room)
            out.append((i, at, take))
            room -= take
            if take < n:
                pieces.append((i, at + take, n - take))
        yield out


def _packed(stats, window: int, dtype: str):
    def pieces(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        idf, mean, _ = stats.value
        rows.sort(key=lambda r: (r[0], str(r[1]), r[2]))
        d = zstandard.ZstdDecompressor()
        docs = [np.frombuffer(d.decompress(z), dtype) for _, _, z in rows]
        out: list[tuple] = []
        for k, sequence in enumerate(Shard(docs, idf, mean, window).windows()):
            offset = 0
            for i, at, n in sequence:
                crc = zlib.crc32(docs[i][at : at + n].astype("<u4").tobytes())
                out.append((rows[i][1], at, n, crc, len(docs[i]), (shard << 32) + k, offset))
                offset += n
        columns = list(zip(*out, strict=True))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind_of[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    kind_of: list = [None]

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            kind_of[0] = batch.schema.field(2).type
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if rows:
                        yield pieces(now, rows)
                    now, rows = shard, []
                rows.append(tuple(row))
        if rows:
            yield pieces(now, rows)

    return run


def pack(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", name: str = "packing") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text, and `end`; null and empty texts have `end` alone. Each id lies in exactly one piece;
    the pieces of a sequence lie one after the other from offset 0. All sequences have `window` ids, but for at most 12 of each shard (of a
    window of 4096), whose lengths are powers of two. Ids of rows are passed through, null or repeated; other columns are ignored; an empty table gives no
    rows. The result doesn't depend on the order or the partitions of the rows.
    """
    spark = df.sparkSession
    with open(tokenizer_path) as f:
        source = f.read()
    shared = spark.sparkContext.broadcast(source)
    tokenizer = ChunkIds(source)
    rows = df.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tokens = materialize(rows.mapInArrow(ba.trimmed(_tokenized(shared, end)), f"row bigint, key bigint, doc_id {id_type}, n bigint, z binary"), name)
    docs = tokens.where("n IS NOT NULL")
    count, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One number for each id of the vocabulary.
    found = tokens.where("n IS NULL").select("z").mapInArrow(ba.trimmed(_frequencies), "id bigint, f bigint").groupBy("id").agg(F.sum("f").alias("f")).collect()
    frequency = np.zeros(max(tokenizer.size, end + 1))
    for r in found:
        frequency[r.id] = r.f
    idf = np.log1p((count - frequency + 0.5) / (frequency + 0.5))
    stats = spark.sparkContext.broadcast((idf, total / max(count, 1), frequency > 1))
    leads = materialize(docs.select("row", "n", "z").mapInArrow(ba.trimmed(_leads(stats, tokenizer.dtype.str)), "row bigint, n bigint, a bigint, b bigint, c bigint"), f"{name}-leads")
    first = leads.groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    dealing = spark.sparkContext.broadcast(Dealing(first.column("a").to_numpy(), first.column("n").to_numpy(), SHARD))
    shards = leads.mapInArrow(ba.trimmed(_sharded(dealing)), "r bigint, n bigint, shard bigint")
    # Copies, and what agrees in all leading terms, may be more than a shard.
    sizes = shards.groupBy("shard").agg(F.ceil(F.sum("n") / (2 * SHARD)).cast("long").alias("salts")).where("salts > 1").select(F.col("shard").alias("s"), "salts")
    shards = shards.join(sizes, F.col("shard") == F.col("s"), "left").select("r", "shard", F.coalesce("salts", F.lit(1)).alias("salts"))
    dealt = docs.join(shards, F.col("row") == F.col("r"))
    dealt = dealt.select((F.col("shard") * (1 << 16) + F.pmod("key", F.col("salts"))).alias("shard"), "key", "doc_id", "z")
    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(ba.trimmed(_packed(stats, window, tokenizer.dtype.str)), schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
