"""Media columns (operator 7): progressive JPEG.

Texts are stored as payloads in the coefficients of a progressive JPEG, 64 bytes
a block, and read back from the stored bytes: the scans (spectral selection and
successive approximation) are accumulated into coefficient arrays, which are
inverse-transformed in numpy, chroma is upsampled, and full-resolution RGB tensors come out.

The reader takes any progressive (or baseline) Huffman JPEG of 8 bits, grey or YCbCr, with restart
intervals. Scans whose codes turn out to have one length are read with array operations, all others
symbol by symbol. The writer lays payloads out so that the first holds:
an AC coefficient has eight magnitude bits, the topmost set; its first scan (Al = 1) gives seven of them behind a
one-bit code, the refinement scan is one run of correction bits; DC takes eight refinement scans.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64
#: Blocks of a unit: 2 x 2 of Y, one of Cb, one of Cr.
UNIT = 6
MAX_UNITS = 4095
#: An end-of-band run covers as many blocks at most.
MAX_RUN = 32767
#: Block rows times columns that are inverse-transformed at a time.
STRIP = 1 << 16
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of the i-th coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Rows: frequencies, columns: samples.
DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * math.pi / 16) * np.where(_K[:, None] == 0, math.sqrt(1 / 8), 0.5)).astype(np.float32)


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, codes: dict[int, list[int]]) -> bytes:
    """A Huffman table; codes: length -> symbols."""
    body = bytes([kind << 4 | slot]) + bytes(len(codes.get(n, ())) for n in range(1, 17))
    return _segment(0xC4, body + bytes(s for n in range(1, 17) for s in codes.get(n, ())))


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    """components: (id, slot of the tables); bits: 0 and 1, padded with ones."""
    head = bytes([len(components)]) + b"".join(bytes([c, slot << 4 | slot]) for c, slot in components) + bytes([first, last, high << 4 | low])
    fill = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits)
    return _segment(0xDA, head) + data.tobytes().replace(b"\xff", b"\xff\x00")


#: Slot 0: DC differences of 0, or (0, 7) in AC. Slot 1, AC only: ends of band, runs of 1 to MAX_RUN blocks.
_TABLES = _table(0, 0, {1: [0x00], 2: [0x01]}) + _table(1, 0, {1: [0x07], 2: [0x00]}) + _table(1, 1, {4: [n << 4 for n in range(15)]})
_IDS = (1, 2, 3)


def write_payload(payload: bytes) -> bytes:
    """A progressive JPEG (4:2:0) whose coefficients are the bytes of payload, 64 bytes a block and at least one block."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-len(payload) // (BLOCK * UNIT))
    columns = min(MAX_UNITS, math.isqrt(units - 1) + 1)
    rows = -(-units // columns)
    if rows > MAX_UNITS:
        raise ValueError("the payload is larger than one JPEG can hold")
    data = np.zeros((rows, columns, UNIT, BLOCK), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = [data[:, :, :4].reshape(rows, columns, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK), data[:, :, 4].reshape(-1, BLOCK), data[:, :, 5].reshape(-1, BLOCK)]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_TABLES)
    every = [(c, 0) for c in _IDS]
    out.append(_scan(every, 0, 0, 0, 8, np.zeros(rows * columns * UNIT, np.uint8)))
    for c, plane in zip(_IDS, planes, strict=True):
        for first, last in ((1, 5), (6, 63)) if c == 1 else ((1, 63),):
            # The code 0, then the bits of v >> 1, or of its complement where v is negative.
            band = plane[:, first : last + 1]
            value = np.where(band & 128, ~(64 | band >> 1) & 127, 64 | (band & 127) >> 1).astype(np.uint8)
            out.append(_scan([(c, 0)], first, last, 0, 1, np.unpackbits(value.reshape(-1))))
    dc = data[:, :, :, 0].reshape(-1)
    for low in range(7, -1, -1):
        out.append(_scan(every, 0, 0, low + 1, low, dc >> low & 1))
    for c, plane in zip(_IDS, planes, strict=True):
        bits = []
        for at in range(0, len(plane), MAX_RUN):
            part = plane[at : at + MAX_RUN, 1:]
            n = len(part).bit_length() - 1
            code = n << n | len(part) - (1 << n)
            bits += [np.array([code >> i & 1 for i in range(n + 3, -1, -1)], np.uint8), (part & 1).reshape(-1)]
        out.append(_scan([(c, 1)], 1, 63, 1, 0, np.concatenate(bits)))
    out.append(b"\xff\xd9")
    return b"".join(out)


# Reading


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[n, code] = symbols[at]
                code += 1
                at += 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits.take(1)
            if (s := self.codes.get((n, code))) is not None:
                return s
        raise ValueError("a code that is in no table")


class _Bits:
    """Bits of a segment of entropy-coded data; ones follow its end."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for i in range(self.at, self.at + n):
            value = value << 1 | (self.bits[i] if i < len(self.bits) else 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


@dataclass
class _Component:
    id: int
    h: int
    v: int
    quant: int
    coefs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: int = 0
    columns: int = 0


class Jpeg:
    """A JPEG read from its bytes: coefficient arrays by component (block rows, block columns, 64 in zigzag order)."""

    def __init__(self, data: bytes):
        self.comment, self.restart = b"", 0
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[int, _Huffman] = {}
        self.components: list[_Component] = []
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            at += 1 if marker == 0xFF else 2
            if marker in (0xFF, 0x01):
                continue
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body)
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("neither baseline nor progressive with Huffman codes")
            elif marker == 0xDA:
                end = _MARKER.search(data, at)
                end = end.start() if end else len(data)
                self._read_scan(body, data[at:end])
                at = end

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, slot = body[at] >> 4, body[at] & 15
            self.quants[slot] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int32)
            at += 1 + 64 * (1 + wide)

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            self.tables[body[at]] = _Huffman(counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or n not in (1, 3):
            raise ValueError("only grey and YCbCr of 8 bits")
        self.components = [_Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.unit_rows, self.unit_columns = -(-self.height // (8 * self.v)), -(-self.width // (8 * self.h))
        for c in self.components:
            c.rows = -(-(-(-self.height * c.v // self.v)) // 8)
            c.columns = -(-(-(-self.width * c.h // self.h)) // 8)
            c.coefs = np.zeros((self.unit_rows * c.v, self.unit_columns * c.h, 64), np.int16)

    def _read_scan(self, body: bytes, data: bytes) -> None:
        by_id = {c.id: c for c in self.components}
        chosen = [(by_id[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
        first, last, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
        alone = len(chosen) == 1
        if not self.restart:
            if first == 0 and last == 0 and high and self._dc_bits(chosen, data, low):
                return
            if first == 0 and last == 0 and not high and self._dc_same(chosen, data):
                return
            if first and not high and self._ac_even(*chosen[0], first, last, low, data):
                return
            if first and high and self._ac_corrected(*chosen[0], first, last, low, data):
                return
        # One symbol after the other.
        if alone:
            c = chosen[0][0]
            units = [[(0, c.coefs[y, x])] for y in range(c.rows) for x in range(c.columns)]
        else:
            units = [
                [(k, c.coefs[y * c.v + j, x * c.h + i]) for k, (c, _) in enumerate(chosen) for j in range(c.v) for i in range(c.h)]
                for y in range(self.unit_rows)
                for x in range(self.unit_columns)
            ]
        parts = _RESTART.split(data) if self.restart else [data]
        size = self.restart or len(units)
        for n, part in enumerate(parts):
            bits, state = _Bits(part), {"run": 0, "dc": [0] * len(chosen)}
            for unit in units[n * size : (n + 1) * size]:
                for k, block in unit:
                    dc, ac = self.tables.get(chosen[k][1] >> 4), self.tables.get(16 | chosen[k][1] & 15)
                    if first == 0:
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            state["dc"][k] += bits.signed(dc.read(bits))
                            block[0] = state["dc"][k] << low
                    if last:
                        (_refine if high else _first)(block, bits, ac, state, max(first, 1), last, low)

    def _dc_order(self, chosen: list) -> list[tuple[np.ndarray, int]]:
        """The DC coefficients of a scan by component, as (unit, block of the unit) arrays."""
        out = []
        for c, _ in chosen:
            if len(chosen) == 1:
                out.append((c.coefs[: c.rows, : c.columns, 0], c.rows * c.columns))
            else:
                out.append((c.coefs[:, :, 0].reshape(self.unit_rows, c.v, self.unit_columns, c.h).transpose(0, 2, 1, 3), c.v * c.h))
        return out

    def _dc_bits(self, chosen: list, data: bytes, low: int) -> bool:
        """Refinement of DC: a bit for each block."""
        views = self._dc_order(chosen)
        bits = _unpacked(data)
        if len(chosen) == 1:
            view, n = views[0]
            view |= (bits[:n].astype(np.int16) << low).reshape(view.shape)
            return True
        per = sum(n for _, n in views)
        bits = bits[: self.unit_rows * self.unit_columns * per].reshape(self.unit_rows, self.unit_columns, per)
        at = 0
        for view, n in views:
            view |= bits[:, :, at : at + n].reshape(view.shape).astype(np.int16) << low
            at += n
        return True

    def _dc_same(self, chosen: list, data: bytes) -> bool:
        """A first scan of DC without any difference."""
        if any(self.tables[t >> 4].codes.get((1, 0)) != 0 for _, t in chosen):
            return False
        n = sum(v.size for v, _ in self._dc_order(chosen))
        bits = _unpacked(data)
        return -(-n // 8) * 8 == len(bits) and not bits[:n].any()

    def _ac_even(self, c: _Component, table: int, first: int, last: int, low: int, data: bytes) -> bool:
        """A first scan in which each coefficient has the one-bit code 0, of a run of 0, and as many bits as the others."""
        symbol = self.tables[16 | table & 15].codes.get((1, 0), 0)
        size, n = symbol & 15, c.rows * c.columns * (last - first + 1)
        bits = _unpacked(data)
        if symbol >> 4 or not size or size > 14 or -(-n * (size + 1) // 8) * 8 != len(bits):
            return False
        bits = bits[: n * (size + 1)].reshape(n, size + 1)
        if bits[:, 0].any():
            return False
        if size == 7:
            value = np.packbits(bits.reshape(-1)).astype(np.int16)
        else:
            value = bits[:, 1:].astype(np.int16) @ (1 << np.arange(size - 1, -1, -1)).astype(np.int16)
        value = np.where(value >> (size - 1), value, value - (1 << size) + 1) * (1 << low)
        c.coefs[: c.rows, : c.columns, first : last + 1] = value.reshape(c.rows, c.columns, -1)
        return True

    def _ac_corrected(self, c: _Component, table: int, first: int, last: int, low: int, data: bytes) -> bool:
        """A refinement of nothing but nonzero coefficients: ends of band, and correction bits."""
        band = c.coefs[: c.rows, : c.columns, first : last + 1]
        if not band.all():
            return False
        bits, codes = _unpacked(data), self.tables[16 | table & 15].codes
        width, blocks, done, at, found = last - first + 1, c.rows * c.columns, 0, 0, []
        while done < blocks:
            code = 0
            for n in range(1, 17):
                if at >= len(bits):
                    return False
                code = code << 1 | int(bits[at])
                at += 1
                if (symbol := codes.get((n, code))) is not None:
                    break
            else:
                return False
            if symbol & 15 or symbol >> 4 == 15:
                return False
            run = 1 << (symbol >> 4)
            for _ in range(symbol >> 4):
                run += int(bits[at]) << ((symbol >> 4) - 1)
                symbol -= 16
                at += 1
            found.append(bits[at : at + run * width])
            at += run * width
            done += run
        found = np.concatenate(found)
        if done != blocks or len(found) != blocks * width:
            return False
        band += np.sign(band) * (found.astype(np.int16) << low).reshape(band.shape)
        return True

    # Samples

    def _samples(self, c: _Component, rows: slice) -> np.ndarray:
        """The samples of some block rows, 0 to 255."""
        coefs = c.coefs[rows]
        n, m = coefs.shape[:2]
        flat = np.empty((n * m, 64), np.float32)
        flat[:, ZIGZAG] = coefs.reshape(-1, 64) * self.quants[c.quant]
        half = (flat.reshape(-1, 8) @ DCT).reshape(-1, 8, 8)
        full = half.transpose(0, 2, 1).reshape(-1, 8) @ DCT
        plane = full.reshape(n, m, 8, 8).transpose(0, 3, 1, 2).reshape(8 * n, 8 * m)
        return np.clip(np.rint(plane + 128), 0, 255)

    def strips(self) -> Iterator[np.ndarray]:
        """RGB, some rows at a time: (rows, width, 3) of uint8."""
        step = max(1, STRIP // max(1, self.unit_columns * self.h * self.v))
        for at in range(0, self.unit_rows, step):
            planes = []
            for c in self.components:
                plane = self._samples(c, slice(at * c.v, (at + step) * c.v))
                for axis, times in ((0, self.v // c.v), (1, self.h // c.h)):
                    plane = np.repeat(plane, times, axis) if times > 1 else plane
                planes.append(plane[: self.height - at * 8 * self.v, : self.width])
            if len(planes) == 1:
                yield np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
                continue
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            out = np.empty((*y.shape, 3), np.uint8)
            for i, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
                out[:, :, i] = np.clip(np.rint(x), 0, 255)
            yield out

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor: (height, width, 3) of uint8."""
        return np.concatenate(list(self.strips()))

    def payload(self) -> bytes:
        """What write_payload() stored."""
        size = int(self.comment.split()[1])
        y, cb, cr = (c.coefs for c in self.components)
        rows, columns = cb.shape[:2]
        units = np.empty((rows, columns, UNIT, BLOCK), np.int16)
        units[:, :, :4] = y.reshape(rows, 2, columns, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, BLOCK)
        units[:, :, 4], units[:, :, 5] = cb, cr
        flat = units.reshape(-1, BLOCK)
        out = np.where(flat < 0, -flat, flat - 128).astype(np.uint8)
        out[:, 0] = flat[:, 0]
        return out.tobytes()[:size]


def _first(block: np.ndarray, bits: _Bits, table: _Huffman, state: dict, first: int, last: int, low: int) -> None:
    if state["run"]:
        state["run"] -= 1
        return
    k = first
    while k <= last:
        symbol = table.read(bits)
        run, size = symbol >> 4, symbol & 15
        if not size:
            if run < 15:
                state["run"] = (1 << run) + bits.take(run) - 1
                return
            k += 16
            continue
        k += run
        block[k] = bits.signed(size) * (1 << low)
        k += 1


def _refine(block: np.ndarray, bits: _Bits, table: _Huffman, state: dict, first: int, last: int, low: int) -> None:
    one, k = 1 << low, first

    def correct(k: int) -> None:
        if bits.take(1):
            block[k] += one if block[k] > 0 else -one

    if not state["run"]:
        while k <= last:
            symbol = table.read(bits)
            run, size, new = symbol >> 4, symbol & 15, 0
            if size:
                new = one if bits.take(1) else -one
            elif run < 15:
                state["run"] = (1 << run) + bits.take(run)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if new and k <= last:
                block[k] = new
            k += 1
    if state["run"]:
        for j in range(k, last + 1):
            if block[j]:
                correct(j)
        state["run"] -= 1


def _unpacked(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))


# Columns


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def feature(jpeg: Jpeg) -> str:
    """Width, height, and mean and mean square of R, G and B."""
    total, square = np.zeros(3, np.int64), np.zeros(3, np.int64)
    for strip in jpeg.strips():
        flat = strip.reshape(-1, 3)
        counts = [np.bincount(flat[:, i], minlength=256) for i in range(3)]
        total += [int(c @ np.arange(256)) for c in counts]
        square += [int(c @ np.arange(256) ** 2) for c in counts]
    n = jpeg.width * jpeg.height
    return f"{jpeg.width}x{jpeg.height};" + ",".join(f"{x / n:.4f}" for x in (*total, *square))


def _mapped(df: DataFrame, id_col: str, value_col: str, fields: list[tuple[str, pa.DataType, str]], row) -> DataFrame:
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("value"))

    def run(batches):
        for batch in batches:
            # Few rows at a time: a tensor takes some six times its text.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [row(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[i] for f in found], t) for i, (_, t, _) in enumerate(fields))], ["doc_id", *(n for n, _, _ in fields)])

    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{n} {s}" for n, _, s in fields)]))


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, media binary: the text in UTF-8 as a progressive JPEG.

    Null and empty texts are a payload of 64 zero bytes. Ids are passed through, null or repeated; other columns are ignored. An empty table gives no rows;
    a long text takes some ten times its size while it is written, one at a time. A payload beyond 6.4 GB raises.
    """
    return _mapped(df, id_col, text_col, [("media", pa.binary(), "binary")], lambda x: (write_payload(payload_of((x or "").encode())),))


def load_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: doc_id, height, width, rgb binary (height x width x 3 of uint8). Null media give nulls."""

    def row(data):
        if data is None:
            return None, None, None
        j = Jpeg(data)
        return j.height, j.width, j.rgb().tobytes()

    return _mapped(df, id_col, media_col, [("height", pa.int32(), "int"), ("width", pa.int32(), "int"), ("rgb", pa.binary(), "binary")], row)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as in store_media(), reads it back from the stored bytes, and returns sizes, digests and features."""

    def row(text):
        data = (text or "").encode()
        media = write_payload(payload_of(data))
        jpeg = Jpeg(media)
        back = jpeg.payload()
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(jpeg)

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    names = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    return _mapped(df, id_col, text_col, [(n, kinds[k], k) for n, k in names.items()], row)


def op7_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
