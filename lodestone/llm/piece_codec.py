"""SentencePiece encoding and decoding (operator 8).

Reads the model file itself: a small protobuf reader, the compiled character
map (a double-array trie of prefixes and their replacements), and BPE with byte
fallback. Normalisation goes by the longest prefix in the map and records, for every
normalised character, where in the source it came from; every piece is then
projected to a span of source bytes.

Encoding is local to chunks: a text is cut only between two characters that stand
side by side in no piece, so no merge can cross a cut and the result is that of the
whole text. Chunks repeat, so their pieces are kept in a bounded cache; those of many texts that it doesn't hold are merged together.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import merges

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Chunks kept by a worker, those that stay when it has so many, and the longest one kept.
CACHE_ENTRIES, KEPT, CACHE_CHARS = 300_000, 60_000, 48
#: From this many symbols on, merges go through a heap.
HEAP_FROM = 160
NONE = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map: trie size, double-array units, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest prefix of data[at:] in the map, and what replaces them; 0 bytes if none is there."""
        units, node, found = self.units, 0, (0, b"")

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node ^= offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= offset(units[node])
            if leaf:
                begin = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[begin : self.strings.index(b"\0", begin)])
        return found


class PieceCodec:
    """Encoder and decoder of one BPE model."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, norm = 1, b""
        for field, value in _fields(model):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append((part[1].decode(), struct.unpack("<f", part.get(2, bytes(4)))[0], part.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
                kind = trainer.get(3, 1)
                self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
            elif field == 3:
                norm = value
        spec = dict(_fields(norm))
        if kind != BPE or any(t in (USER_DEFINED, UNUSED) for _, _, t in self.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.map = CharacterMap(spec[2]) if len(spec.get(2, b"")) > 4 else None
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.score = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        #: No piece goes on from another character into a space: texts can be cut there, and at line ends if these are in no piece.
        spaced = all(a == SPACE for a, b in self.joined if b == SPACE)
        lined = all("\n" not in x for x in self.joined)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if lined else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if spaced else re.compile("(?s).+")
        self.merges = self._merges()
        self.cache = _Chunks(self)
        #: What an id stands for; none for the bytes of longer characters, which have to be seen together.
        self.surfaces = [chr(b) if (b := self.byte_of.get(i, 128)) < 128 else None if t == BYTE else self.unk_surface if t == UNKNOWN else "" if t == CONTROL else p.replace(SPACE, " ") for i, (p, _, t) in enumerate(self.pieces)]
        self.plain = self.map is None and self.escape and not self.squeeze and self.dummy

    def _merges(self) -> merges.Merges | None:
        """Merges by the numbers of symbols: ids of pieces, then characters that are in pieces alone, then one number for all other characters. None for a model without pieces."""
        if not self.score:
            return None
        ranks = {s: r for r, s in enumerate(sorted({*self.score.values()}, reverse=True))}
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p if c not in self.ids}):
            symbols[c] = len(self.pieces) + len(symbols) - len(self.ids)
        others = len(self.pieces) + len(symbols) - len(self.ids)
        single = {ord(c): n for c, n in symbols.items() if len(c) == 1}
        self.symbol = np.full(max(single) + 2, others, np.int32)
        self.symbol[[*single]] = [*single.values()]
        #: Source bytes of each symbol: a space for each mark.
        self.lengths = np.zeros(others + 1, np.int32)
        self.lengths[[*symbols.values()]] = [len(p.encode()) - 2 * p.count(SPACE) for p in symbols]
        get = symbols.get
        pairs = [(a, b, ranks[s], self.ids[p]) for p, s in self.score.items() for i in range(1, len(p)) if (a := get(p[:i])) is not None and (b := get(p[i:])) is not None]
        return merges.Merges(*np.array(pairs, np.int64).reshape(-1, 4).T)

    # Normalisation

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters, and its end, the source byte at which it begins."""
        data, out, starts = text.encode(), [], []
        space = SPACE if self.escape else " "
        at = 0
        while at < len(data):
            size, new = self.map.longest(data, at) if self.map else (0, b"")
            if not size:
                size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                new = data[at : at + size]
            for c in new.decode(errors="replace"):
                c = space if c == " " else c
                if not (self.squeeze and c == space and (not out or out[-1] == space)):
                    out.append(c)
                    starts.append(at)
            at += size
        end = len(data)
        while self.squeeze and out and out[-1] == space:
            out.pop()
            end = starts.pop()
        if self.dummy and out:
            out.insert(0, space)
            starts.insert(0, starts[0])
        return "".join(out), [*starts, end]

    # Encoding

    def merged(self, chunk: str) -> list[str]:
        """BPE: the best-scored neighbours first, the leftmost of equals."""
        symbols, get = list(chunk), self.score.get
        if len(symbols) >= HEAP_FROM:
            return self._merged_long(symbols)
        ranks = [*map(get, map(add, chunk, chunk[1:]), repeat(NONE))]
        while ranks and (best := max(ranks)) != NONE:
            i = ranks.index(best)
            new = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] + new, NONE)
            if i < len(ranks):
                ranks[i] = get(new + symbols[i + 1], NONE)
        return symbols

    def _merged_long(self, symbols: list) -> list[str]:
        n, get = len(symbols), self.score.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := get(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(pair)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def parts(self, chunk: str) -> list[str]:
        """A long chunk, cut where no piece can span the cut."""
        joined, begin, out = self.joined, 0, []
        if len(chunk) <= CACHE_CHARS:
            return [chunk]
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in joined:
                out.append(chunk[begin:i])
                begin = i
        out.append(chunk[begin:])
        return out

    def chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids, and the characters of the chunk that each takes: of a character in bytes, the first id has it."""
        pieces = self.merged(chunk) if len(chunk) <= CACHE_CHARS else [x for part in self.parts(chunk) for x in self.merged(part)]
        found = [*map(self.ids.get, pieces)]
        if None not in found:
            return found, [*map(len, pieces)]
        ids, sizes = [], []
        for piece, i in zip(pieces, found, strict=True):
            if i is None and self.bytes:
                raw = piece.encode()
                ids.extend(self.bytes[b] for b in raw)
                sizes.extend([len(piece)] + [0] * (len(raw) - 1))
            else:
                ids.append(self.unk if i is None else i)
                sizes.append(len(piece))
        return ids, sizes

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the source bytes where each begins and ends. The ids of one character in bytes share its span."""
        normal, starts = self.normalise(text)
        ids, begins, ends, at = [], [], [], 0
        for c in self.cut.findall(normal):
            new, sizes = self.chunk(c)
            ids.extend(new)
            for size in sizes:
                if size or not begins:
                    begin, at = at, at + size
                begins.append(starts[begin])
                ends.append(starts[at])
        return ids, begins, ends

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text whose normalisation only marks spaces; none for other texts."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if self.plain and text and SPACE not in text else []

    def aligned(self, text: str, chunks: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """encode() in arrays, and the ids in decimal joined by commas. chunks: those of the text, which carry the source bytes of their pieces."""
        chunks = self.chunks(text) if chunks is None else chunks
        if not chunks:
            ids, begins, ends = (np.array(x, kind) for x, kind in zip(self.encode(text), (np.int32, np.int64, np.int64), strict=True))
            return ids, begins, ends, ",".join(map(str, ids.tolist()))
        listed, ids, sizes = zip(*map(self.cache.__getitem__, chunks), strict=True)
        ids = np.frombuffer(b"".join(ids), np.int32)
        sizes = np.frombuffer(b"".join(sizes), np.int32).astype(np.int64)
        sizes[0] -= 1  # the space put in front is in no source
        at = np.cumsum(sizes)
        own = np.maximum.accumulate(np.where(sizes > 0, np.arange(len(sizes)), 0))  # of a character in bytes, the first id has the span of all
        return ids, (at - sizes)[own], at[own], ",".join(listed)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, int]]:
        """digested() of each text; chunks that are new are worked out together."""
        for part in merges.portions(texts):
            chunks = [*map(self.chunks, part)]
            self.cache.learn(chain.from_iterable(chunks))
            yield from map(self.digested, part, chunks)

    def digested(self, text: str, chunks: list[str] | None = None) -> tuple[int, str, str, int]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of what decode() makes of them, CRC-32 of the begins and ends of their source spans (64-bit numbers)."""
        ids, begins, ends, listed = self.aligned(text, chunks)
        decoded = self.decode(ids.tolist())
        spans = zlib.crc32(ends.tobytes(), zlib.crc32(begins.tobytes()))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), spans

    # Decoding

    def surface(self, ids: list[int]) -> str:
        """What the ids stand for, spaces that begin a text included."""
        try:
            return "".join(map(self.surfaces.__getitem__, ids))
        except TypeError:
            pass  # ids whose surface takes the others around them have none of their own
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i is not None:
                piece, _, kind = self.pieces[i]
                out.append(self.unk_surface if kind == UNKNOWN else "" if kind == CONTROL else piece.replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text: the space that normalisation put in front is taken away again."""
        first = next((i for i in ids if self.pieces[i][2] != CONTROL), None)
        text = self.surface(ids)
        if first is not None and (self.dummy or self.squeeze) and self.pieces[first][0].startswith(SPACE):
            text = text.lstrip(" ") if self.squeeze else text[1:]
        return text


def _utf8(data: bytes) -> str:
    """Characters of the bytes; each byte that is part of none becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Chunks(dict):
    """Chunk -> (ids in decimal joined by commas, ids, source bytes of each: a space for each mark), the last two as bytes; when full, those that came first stay."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        self.decimal = [str(i) for i in range(len(codec.pieces))]
        self.digits = np.array([len(x) for x in self.decimal] or [0])

    def shrink(self) -> None:
        if len(self) >= CACHE_ENTRIES:
            first = [*islice(self.items(), KEPT)]
            self.clear()
            self.update(first)

    def learn(self, chunks: Iterable[str]) -> None:
        """Adds what it doesn't hold of these, but for chunks with characters that are no pieces."""
        codec = self.codec
        if codec.merges is None:
            return
        self.shrink()
        new = [c for c in dict.fromkeys(chunks) if c not in self and len(c) <= CACHE_CHARS]
        if not new:
            return
        points = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        ids, counts = codec.merges.merged(codec.symbol[np.minimum(points, len(codec.symbol) - 1)], np.fromiter(map(len, new), np.int64, len(new)))
        ends = np.cumsum(counts)
        known = np.logical_and.reduceat(ids < len(self.decimal), ends - counts)
        raw, sizes = ids.tobytes(), codec.lengths[ids].tobytes()
        shown = np.minimum(ids, len(self.decimal) - 1)
        listed, comma = ",".join(map(self.decimal.__getitem__, shown.tolist())), np.cumsum(self.digits[shown] + 1)
        i = a = 0
        for c, own, j, b in zip(new, known.tolist(), (4 * ends).tolist(), comma[ends - 1].tolist(), strict=True):
            if own:
                self[c] = listed[a : b - 1], raw[i:j], sizes[i:j]
            i, a = j, b

    def __missing__(self, chunk: str) -> tuple[str, bytes, bytes]:
        ids, sizes = self.codec.chunk(chunk)
        if not (chunk.isascii() or chunk.replace(SPACE, "").isascii()):
            at, own = 0, []
            for n in sizes:
                part = chunk[at : at + n]
                own.append(len(part.encode()) - 2 * part.count(SPACE))
                at += n
            sizes = own
        value = (",".join(map(self.decimal.__getitem__, ids)), array("i", ids).tobytes(), array("i", sizes).tobytes())
        if len(chunk) <= CACHE_CHARS:
            self.shrink()
            self[chunk] = value
        return value


_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec a worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _rows(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("value"))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, begins array<long>, ends array<long> (source bytes).

    Null and empty texts have no ids. Ids of rows are passed through, null or repeated; other columns are ignored.
    An empty table gives no rows. The model (some 0.5 MB, as large as its vocabulary) is read by the driver and broadcast.
    """
    rows = _rows(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches):
        c = codec(model.value)
        for batch in batches:
            found = [c.encode(x or "") for x in batch.column(1).to_pylist()]
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate(kinds))], ["doc_id", "ids", "begins", "ends"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Null and empty lists of ids give an empty text."""
    rows = _rows(df, id_col, ids_col)
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches):
        c = codec(model.value)
        for batch in batches:
            texts = pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32, of encoding each text with the spans of its pieces, and decoding the ids.

    Null and empty texts have no ids; other edges are as in encode().
    """
    rows = _rows(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches):
        c = codec(model.value)
        for batch in batches:
            found = [*c.digests([x or "" for x in batch.column(1).to_pylist()])]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
