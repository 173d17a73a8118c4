import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import media_jpeg as M
from lodestone.llm import packing as P
from lodestone.llm import piece_codec as C
from lodestone.llm import quality_crf as Q
from lodestone.llm import suffix_dedup as S
from lodestone.llm import toxicity as X
from lodestone.llm.jaccard_join import drop_near_duplicates, jaccard_join

from .conftest import edge_rows, sentence

tokens = pytest.importorskip("public_tokenizers")


# 1


def brute_repeats(texts, width):
    places = {}
    for d, b in enumerate(texts):
        for i in range(len(b) - width + 1):
            places.setdefault(b[i : i + width], []).append((d, i))
    out = []
    covered = [np.zeros(len(b) + 1, np.int64) for b in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                covered[d][i] += 1
                covered[d][i + width] -= 1
    for b, c in zip(texts, covered, strict=True):
        gone = np.cumsum(c)[: len(b)] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def small(rows):
    return [(i, x[:3000] if x else x) for i, x in rows]


@pytest.mark.parametrize("hot,kinds,held", [(20_000, 8, 200_000), (2, 1, 3), (20_000, 1, 200_000), (20_000, 8, 2)])
def test_suffix_dedup(spark, hot, kinds, held, monkeypatch):
    monkeypatch.setattr(S, "KINDS", kinds)
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "CHUNK", 16 if kinds == 1 else 8_000)
    rows = small(edge_rows())
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for width in (200, 100):
        want = sorted(((i, *w[:4]) for (i, _), w in zip(rows, brute_repeats([(x or "").encode() for _, x in rows], width), strict=True)), key=str)
        assert sorted(map(tuple, S.suffix_digests(df, width, hot=hot).collect()), key=str) == want
        assert any(w[2] and w[2] < w[1] for w in want)


def test_last_run_of_a_forced_anchor_is_sent():
    import pyarrow as pa

    def batch(pk, rkeys):
        n = len(rkeys)
        return pa.RecordBatch.from_arrays([pa.array([pk] * n), pa.array([pk] * n), pa.array(rkeys), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([9] * n, pa.int32())], ["deal", "pk", "rkey", "rid", "begin", "shape"])

    out = [r for b in S._judge(iter([batch(1, [1, 2, 3, 4, 5]), batch(2, [6]), batch(3, [7])]), 3) for r in b.to_pylist()]
    assert [r["rkey"] for r in out if r["send"] and r["pk"] == 1] == [1, 2, 3, 4, 5]
    assert not [r for r in out if r["pk"] == 2]


def test_suffix_dedup_keeps_columns(spark, edge, empty):
    out = S.suffix_dedup(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert {r.text for r in out.where("doc_id = 6").collect()} == {""}
    assert S.suffix_digests(empty).count() == 0 and S.suffix_dedup(empty).count() == 0


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 5000)
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 30_000).astype(np.uint8)
    data[20_000:21_000] = data[3_000:4_000]
    found = []
    for _, _, begin, end in S._pieces(np.array([0, len(data)]), 200):
        _, first, last, _, _ = S.anchors(data[begin:end], np.array([0, end - begin]), 200)
        found += [(begin + f, begin + l) for f, l in zip(first, last, strict=True)]
    starts = sorted(s for f, l in found for s in range(f, l - 199))
    assert starts == list(range(len(data) - 199))  # each window in one run


def test_multikey_order():
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 5, 30_000).astype(np.uint64), rng.integers(0, 50, 30_000).astype(np.uint64)]
    order = S.multikey_order(tokens)
    assert sorted(order) == list(range(30_000))
    got = list(zip(tokens[0][order], tokens[1][order], strict=True))
    assert got == sorted(got)


# 3


def quality_texts(rng, n):
    good = ["\n".join(sentence(rng, 12) for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    bad = ["\n".join(" ".join(w.upper() + "!!" for w in sentence(rng, 12).split()) for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    return good + bad, [1] * n + [0] * n


def test_quality(spark, edge, empty):
    rng = random.Random(5)
    model = Q.LineCrf.fit(*quality_texts(rng, 150))
    texts, labels = quality_texts(rng, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in Q.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in enumerate(labels)]) > 0.97
    scores = [r.score for r in Q.score(edge, model).collect()]
    assert len(scores) == edge.count() and all(0 <= s <= 1 for s in scores)
    assert Q.score(empty, model).count() == 0
    assert set(Q.LineCrf.fit([], []).scores(np.zeros(0, np.uint8), np.array([0, 0]))) == {0.5}


def test_crf_marginals_against_enumeration():
    import itertools

    import pyarrow as pa

    from lodestone.llm import byte_arrays as ba

    rng = np.random.default_rng(2)
    lines = Q.lines_of(*ba.flat(pa.array(["a b\nC d!\n\nxx 12", "one"])))
    width = lines.features.shape[1]
    model = Q.LineCrf(np.zeros(width), np.ones(width), rng.normal(size=width), rng.normal(size=(3, 2)))
    good, got = model.unary(lines), model.marginals(lines)
    for first, n in zip(lines.first, lines.counts, strict=True):
        weight = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            s = model.chain[0, y[0]] + sum(model.chain[1 + a, b] for a, b in zip(y, y[1:])) + sum(good[first + t] for t in range(n) if y[t])
            weight[y] = np.exp(s)
        total = sum(weight.values())
        for t in range(n):
            assert np.isclose(got[first + t], sum(w for y, w in weight.items() if y[t]) / total)


def test_document_score_is_the_mean_of_its_lines_by_length():
    import pyarrow as pa

    from lodestone.llm import byte_arrays as ba

    model = Q.LineCrf.fit(*quality_texts(random.Random(6), 40), rounds=20)
    texts = ["one line", "", "SHOUT!! SHOUT!!\na b c\n\nmore words here", "x\n" * 50]
    data, offsets = ba.flat(pa.array(texts, pa.large_string()))
    got = model.scores(data, offsets)
    for text, found in zip(texts, got, strict=True):
        alone = ba.flat(pa.array([text], pa.large_string()))
        weights = [len(line.encode()) + 1 for line in text.split("\n")]
        good = model.marginals(Q.lines_of(*alone))
        assert len(good) == len(weights) and np.isclose(found, np.dot(good, weights) / sum(weights))


# 5


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(spark, empty, window):
    from tokenizers import Tokenizer

    rows = [(i, x) for i, x in small(edge_rows()) if i is not None] + [(None, "no id")]
    rows = [(i, x) for k, (i, x) in enumerate(rows) if i not in [j for j, _ in rows[:k]]]
    path = tokens.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in rows}
    got = P.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path, window).collect()
    at = dict.fromkeys(ids, 0)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    lengths = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n == window or n & (n - 1) == 0 for n in lengths.values()) and max(lengths.values()) <= window
    assert P.pack(empty, path, window).count() == 0


def test_packing_puts_neighbours_together():
    idf = np.ones(100)
    docs = [np.array([1, 2, 3] * 10, "<u2"), np.array([50, 51] * 5, "<u2"), np.array([1, 2, 4] * 10, "<u2"), np.array([50, 52] * 5, "<u2")]
    first = next(P.Shard(docs, idf, 20.0, 60).windows())
    assert {i for i, _, _ in first} == {0, 2}


def test_neighbours_are_those_of_brute_bm25():
    """The order of the index is that of BM25 added up term by term."""
    import math

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 60, rng.integers(1, 90)).astype("<u2") for _ in range(80)]
    df = np.array([sum(t in d for d in docs) for t in range(60)])
    idf, mean = np.log1p((80 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    shard = P.Shard(docs, idf, mean, 64)
    for seed in range(0, 80, 7):
        want = []
        for d in docs:
            score = 0.0
            for t in set(docs[seed].tolist()):
                tf = int((d == t).sum())
                score += math.log(1 + (80 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            want.append(score)
        assert np.allclose(shard.scores(seed), want)


def test_packing_deals_by_leading_terms(spark, monkeypatch):
    """Copies and near copies share a shard, shards are bounded, and a group of copies larger than a shard is divided."""
    monkeypatch.setattr(P, "SHARD", 2000)
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    rows = [(100 * i + k, b if k < 2 else b.replace("alpha", "beta", 1)) for i, b in enumerate(base) for k in range(4)] + [(5000 + k, base[0]) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = P.pack(df, tokens.path("word_bpe_49k.json"), 256).collect()
    shard, size = {}, {}
    for r in got:
        shard[r.doc_id] = r.sequence_id >> 32
        size[r.sequence_id >> 32] = size.get(r.sequence_id >> 32, 0) + r.length
    assert max(size.values()) < 3 * 2000 and len({shard[i] for i in range(5000, 5150)}) > 1
    assert np.mean([shard[100 * i] == shard[100 * i + k] for i in range(1, 12) for k in range(1, 4)]) > 0.8


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), P.ChunkIds(open(path).read())
    rng = random.Random(3)
    alphabet = [*"abe THE \n\t\r\x0b\x1c\x85.,!'s0é中😀́ ​İΣ", "ing", "<|endoftext|>"]
    for _ in range(500):
        x = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60])))
        assert t.encode(x, add_special_tokens=False).ids == c.ids([x], None)[0].tolist()


def test_new_words_of_many_texts_are_merged_together(monkeypatch):
    """One call of the merges for all words of a portion that aren't known, with the library's ids, also where chunks have to go."""
    from tokenizers import Tokenizer

    path = tokens.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), P.ChunkIds(open(path).read())
    calls, merged = [], c.merges.merged
    monkeypatch.setattr(c.merges, "merged", lambda *a: calls.append(1) or merged(*a))
    rng = random.Random(5)
    letters = [*"aeioustrnlTHEéèßŒſ0.,'’-", "tion", "ing", "'s", "ou"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 8, 20, 70])))
    texts = [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.choice([0, 1, 30]))) for _ in range(200)] + ["", " \n", "İx y", "a <|endoftext|> b"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in c.ids(texts, None)] == want
    assert len(calls) <= 2  # of simple texts, and of the others
    monkeypatch.setattr(P, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(P, "KEPT", 20)
    monkeypatch.setattr(P.merges, "PORTION", 500)
    assert [x.tolist() for x in c.ids(texts, 2)] == [[*x, 2] for x in want]
    c.shrink(7)
    assert len(c) == 7 and [x.tolist() for x in c.ids(texts, None)] == want


def test_words_begin_where_the_split_has_them():
    import re

    word = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ a-z0-9ß-öø-ſ]+")
    rng = random.Random(8)
    parts = [*"abselvrtmd09éſß'' ;.-", "'s", "'ll", "'re", "'ve", "'l", "'r", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 12])))
        want = [len(text[: m.start()].encode()) for m in word.finditer(text)]
        assert np.flatnonzero(P._word_begins(np.frombuffer(text.encode(), np.uint8))).tolist() == want, text


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_terms_of_many_documents_are_counted_in_one_sort(monkeypatch, dtype):
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 50, rng.integers(0, 70)).astype(dtype) for _ in range(300)]
    want = [(i, int(t), int(n)) for i, d in enumerate(docs) for t, n in zip(*np.unique(d, return_counts=True), strict=True)]
    assert [*zip(*(x.tolist() for x in P.counted(docs)), strict=True)] == want
    assert [*zip(*(x.tolist() for x in P.counted(docs, by_term=True)), strict=True)] == sorted(want, key=lambda x: (x[1], x[0]))
    assert [len(x) for x in P.counted([])] == [0, 0, 0]
    idf, shared = rng.integers(1, 4, 50).astype(float), np.arange(50) % 5 > 0
    best = []
    for d in docs:
        terms, tf = np.unique(d, return_counts=True)
        weight = idf[terms] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 30.0))
        best.append([t for _, t in sorted((-w, int(t)) for w, t in zip(weight.tolist(), terms, strict=True) if shared[t])[:3]])
    calls, counted = [], P.counted
    monkeypatch.setattr(P, "counted", lambda *a: calls.append(1) or counted(*a))
    found = P.leading_terms(docs, idf, 30.0, shared)
    assert [[t for t in r if t >= 0] for r in found.tolist()] == best and len(calls) == 1
    monkeypatch.setattr(P, "SHARD", 100)
    assert P.leading_terms(docs, idf, 30.0, shared).tolist() == found.tolist() and len(calls) > 50


def test_merges_against_one_at_a_time():
    from lodestone.llm import merges

    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (500, 2))})
    rank = rng.integers(0, 60, len(pairs))  # several pairs have the same rank
    made = np.where(rank % 3, rng.integers(0, 40, len(pairs)), rank % 40)  # of some, all make the same symbol
    m = merges.Merges(*np.array(pairs).T, rank, made)
    ranks, makes = dict(zip(pairs, rank.tolist(), strict=True)), dict(zip(pairs, made.tolist(), strict=True))
    words = [rng.integers(0, 40, n).tolist() for n in rng.integers(1, 12, 300)]
    want = []
    for w in map(list, words):
        while found := [(ranks[p], i) for i, p in enumerate(zip(w, w[1:], strict=False)) if p in ranks]:
            _, i = min(found)
            w[i : i + 2] = [makes[w[i], w[i + 1]]]
        want.append(w)
    got, counts = m.merged(np.concatenate(words).astype(np.int32), np.array([*map(len, words)]))
    assert counts.tolist() == [*map(len, want)] and got.tolist() == [x for w in want for x in w]
    assert [x.tolist() for x in m.merged(np.zeros(0, np.int32), np.zeros(0, np.int64))] == [[], []]


# 7


def test_media(spark, edge, empty):
    got = M.media_digests(edge).collect()
    assert len(got) == edge.count()
    want = sorted(hashlib.sha256(M.payload_of((x or "").encode())).hexdigest() for _, x in edge_rows())
    assert sorted(r.payload_sha256 for r in got) == want
    assert all(r.payload_bytes == max(64, -(-r.n_bytes // 64) * 64) for r in got)
    tensors = M.load_media(M.store_media(edge.where("doc_id IN (1, 6, 60)"))).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in tensors)
    assert M.media_digests(empty).count() == 0


@pytest.mark.parametrize("size,padded", [(0, 64), (1, 64), (63, 64), (64, 64), (65, 128), (128, 128)])
def test_payload_ends_at_a_multiple(size, padded):
    data = b"x" * size
    assert M.payload_of(data) == data + bytes(padded - size)


@pytest.mark.parametrize("text", ["", "a", "some words " * 40])
def test_feature_of_the_whole_tensor(text):
    jpeg = M.Jpeg(M.write_payload(M.payload_of(text.encode())))
    pixels = np.asarray(jpeg.rgb()).reshape(-1, 3).astype(np.float64)
    size, numbers = M.feature(jpeg).split(";")
    assert size == f"{jpeg.width}x{jpeg.height}" and len(pixels) == jpeg.width * jpeg.height
    assert np.allclose([float(x) for x in numbers.split(",")], [*pixels.mean(0), *(pixels**2).mean(0)], atol=1e-4)


@pytest.mark.parametrize("blocks", [1, 6, 7, 500, 40_000])
def test_jpeg_payload_round_trip(blocks):
    payload = os.urandom(64 * blocks)
    assert M.Jpeg(M.write_payload(payload)).payload() == payload


def test_jpeg_symbol_by_symbol(monkeypatch):
    """The general reader reads what the array reader does."""
    payload = os.urandom(64 * 13)
    data = M.write_payload(payload)
    fast = M.Jpeg(data).rgb()
    for name in ("_dc_bits", "_dc_same", "_ac_even", "_ac_corrected"):
        monkeypatch.setattr(M.Jpeg, name, lambda *a: False)
    slow = M.Jpeg(data)
    assert slow.payload() == payload and (slow.rgb() == fast).all()


def jpeg_of(coefs, scans, restart=0):
    """A grey progressive JPEG of sparse coefficients (rows, columns, 64), with a flat Huffman table."""
    symbols = list(range(256))
    code = {s: (8, i) if i < 254 else (9, 508 + i - 254) for i, s in enumerate(symbols)}
    table = lambda kind: M._segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [254, 2] + [0] * 7) + bytes(symbols))
    rows, columns = coefs.shape[:2]
    out = [b"\xff\xd8", M._segment(0xDB, b"\0" + bytes(range(1, 65))), M._segment(0xC2, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * columns).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])), table(0), table(1)]
    if restart:
        out.append(M._segment(0xDD, restart.to_bytes(2, "big")))
    blocks = coefs.reshape(-1, 64)

    def magnitude(v):
        n = int(abs(v)).bit_length()
        return n, [(int(v) if v > 0 else int(v) + (1 << n) - 1) >> i & 1 for i in range(n - 1, -1, -1)]

    def put(bits, s):
        n, c = code[s]
        bits += [c >> i & 1 for i in range(n - 1, -1, -1)]

    shift = lambda v, low: int(np.sign(v)) * (abs(int(v)) >> low)
    for first, last, high, low in scans:
        parts = []
        size = restart or len(blocks)
        for at in range(0, len(blocks), size):
            bits, dc = [], 0
            for b in blocks[at : at + size]:
                if first == 0 and not high:
                    v = int(b[0]) >> low
                    n, extra = magnitude(v - dc)
                    put(bits, n)
                    bits += extra
                    dc = v
                elif first == 0:
                    bits.append(int(b[0]) >> low & 1)
                elif not high:
                    run = 0
                    for k in range(first, last + 1):
                        v = shift(b[k], low)
                        if not v:
                            run += 1
                            continue
                        while run > 15:
                            put(bits, 0xF0)
                            run -= 16
                        n, extra = magnitude(v)
                        put(bits, run << 4 | n)
                        bits += extra
                        run = 0
                    if run:
                        put(bits, 0)
                else:
                    run, pending = 0, []
                    tail = max([k for k in range(first, last + 1) if abs(int(b[k])) >> low == 1], default=first - 1)
                    for k in range(first, last + 1):
                        v = abs(int(b[k])) >> low
                        if v > 1:
                            pending.append(v & 1)
                        elif v == 1:
                            put(bits, run << 4 | 1)
                            bits.append(int(b[k] > 0))
                            bits += pending
                            run, pending = 0, []
                        elif k < tail:
                            if run == 15:
                                put(bits, 0xF0)
                                bits += pending
                                run, pending = -1, []
                            run += 1
                    if tail < last:
                        put(bits, 0)
                        bits += pending
            bits += [1] * (-len(bits) % 8)
            parts.append(np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00"))
        data = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
        out.append(M._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + data)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 5])
def test_progressive_reader(restart):
    rng = np.random.default_rng(4)
    coefs = np.zeros((4, 5, 64), np.int64)
    mask = rng.random(coefs.shape) < 0.2
    coefs[mask] = rng.integers(-200, 200, mask.sum())
    coefs[:, :, 0] = rng.integers(-300, 300, (4, 5))
    scans = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
    j = M.Jpeg(jpeg_of(coefs, scans, restart))
    assert (j.components[0].coefs == coefs).all()
    y, x = np.mgrid[:8, :8]
    block = np.zeros((8, 8))
    flat = np.zeros(64)
    flat[M.ZIGZAG] = coefs[1, 2] * np.arange(1, 65)
    for v in range(8):
        for u in range(8):
            cu, cv = (np.sqrt(0.5) if u == 0 else 1), (np.sqrt(0.5) if v == 0 else 1)
            block += cu * cv / 4 * flat[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    want = np.clip(np.rint(block + 128), 0, 255)
    assert np.abs(j.rgb()[8:16, 16:24, 0].astype(int) - want).max() <= 1


# 8


def test_pieces_like_the_library(spark, edge, empty):
    import sentencepiece

    path = tokens.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    c = C.PieceCodec(C._read(path))
    for x in ("Hello  world, and more", "Plain text\nof two lines ", " x"):
        assert [(p.begin, p.end) for p in sp.encode(x, return_type="proto").pieces] == list(zip(*c.encode(x)[1:], strict=True))
    got = sorted(map(tuple, C.round_trip(edge, path).collect()), key=str)
    want = []
    for i, x in edge_rows():
        ids = sp.encode(x or "")
        spans = [np.array(v, np.int64) for v in c.encode(x or "")[1:]]
        crc = zlib.crc32(spans[1].tobytes(), zlib.crc32(spans[0].tobytes()))
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), crc))
    assert got == sorted(want, key=str)
    short = edge.where("doc_id IN (1, 2, 3, 60, 61)")
    coded = C.encode(short, path)
    for r in coded.join(C.decode(coded, path), "doc_id").join(short.select("doc_id", "text"), "doc_id").select("ids", "begins", "ends").collect():
        assert len(r.ids) == len(r.begins) == len(r.ends)
    assert C.round_trip(empty, path).count() == C.encode(empty, path).count() == 0


def test_new_chunks_of_many_texts_are_merged_together(monkeypatch):
    """No chunk of known characters goes through the merges of one alone; the results are the library's and those of one at a time, also where chunks have to go."""
    import sentencepiece

    path = tokens.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    one, c = C.PieceCodec(C._read(path)), C.PieceCodec(C._read(path))
    alone, merged = [], c.merged
    monkeypatch.setattr(c, "merged", lambda chunk: alone.append(chunk) or merged(chunk))
    rng = random.Random(6)
    letters = [*"aeioustrnlTHEéè0.,'", "aaa", "tion", "ing", "ou", "  ", "     "]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 9]))) for _ in range(rng.choice([0, 1, 40]))) for _ in range(150)]
    want = [one.digested(x) for x in texts]
    assert [*c.digests(texts)] == want and not [x for x in alone if len(x) <= C.CACHE_CHARS]
    assert [(n, h) for n, h, _, _ in want] == [(len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for i in map(sp.encode, texts)]
    monkeypatch.setattr(C, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(C, "KEPT", 10)
    monkeypatch.setattr(C.merges, "PORTION", 300)
    texts += ["", "😀 中x", "▁a", "a\nb", "x" * 200, "\ue000é"]
    assert [*c.digests(texts)] == [*want, *map(one.digested, texts[150:])]
    assert [n for n, *_ in c.digests(texts)] == [len(sp.encode(x)) for x in texts]


def test_spans_cover_the_source():
    c = C.PieceCodec(C._read(tokens.path("piece_bpe_32k.model")))
    for x in ("Hello  world", " é中😀\nok", "▁a ▁", "a" * 300):
        ids, begins, ends = c.encode(x)
        data = x.encode()
        assert begins[0] == 0 and ends[-1] == len(data)
        assert [a.tolist() for a in c.aligned(x)[:3]] == [ids, begins, ends]
        assert c.decode(ids) == x.replace("▁", " ")
        for i, b, e in zip(ids, begins, ends, strict=True):
            piece = c.pieces[i][0]
            if b < e and i not in c.byte_of:
                assert data[b:e].decode().replace(" ", "▁") in (piece, piece[1:])


def test_character_map_takes_the_longest_prefix():
    """A double array of three prefixes, made by hand: a -> x, ab -> yz, abc -> (nothing)."""
    import struct

    strings = b"x\0yz\0\0"
    keys = {b"a": 0, b"ab": 2, b"abc": 5}
    units = [0] * 2048
    trie, used, bases = {}, {0}, set()
    for k, v in keys.items():
        node = trie
        for ch in k:
            node = node.setdefault(ch, {})
        node[None] = v

    def place(node, at):
        base = next(b for b in range(256, 2048) if b not in bases and all((b ^ (ch or 0)) not in used and (b ^ (ch or 0)) < 2048 for ch in node))
        bases.add(base)
        for ch in node:
            used.add(base ^ (ch or 0))
        units[at] |= (base ^ at) << 10
        for ch, child in node.items():
            if ch is None:
                units[at] |= 1 << 8
                units[base] = 1 << 31 | child
            else:
                units[base ^ ch] |= ch
                place(child, base ^ ch)

    place(trie, 0)
    m = C.CharacterMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings)
    assert m.longest(b"abd", 0) == (2, b"yz") and m.longest(b"xabc", 1) == (3, b"") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"b", 0) == (0, b"")
    codec = C.PieceCodec(C._read(tokens.path("piece_bpe_32k.model")))
    codec.map = m
    assert codec.normalise("abd ac") == ("▁yzd▁xc", [0, 0, 0, 2, 3, 4, 5, 6])


# 9


@pytest.mark.parametrize("width,percent,region,heavy", [(3, 90, 1 << 21, 1000), (5, 80, 1 << 21, 1), (5, 80, 500, 1 << 40), (2, 60, 300, 20)])
def test_jaccard_join(spark, edge, monkeypatch, width, percent, region, heavy):
    """heavy: no signature is a heavy one with 1, and every one that several sets of the sample have with a large number."""
    import re

    from lodestone.llm import jaccard_join as J

    monkeypatch.setattr(J, "REGION", region)
    monkeypatch.setattr(J, "HEAVY", heavy)
    rows = edge_rows()
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, (i, x) in enumerate(rows):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low))
        sets[k] = (i, {tuple(ws[j : j + width]) for j in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (ia, sa) in sets.items():
        for b, (ib, sb) in sets.items():
            same = ia is not None and ia == ib and sa and sb
            if a < b and (same or (sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb))):
                root[find(b)] = find(a)
    names = {}
    for k, (i, s) in sets.items():
        if i is not None and s:
            names[find(k)] = min(names.get(find(k), i), i)
    got = sorted(map(tuple, jaccard_join(edge, width, percent).collect()), key=str)
    want = sorted(((i, len(s), names.get(find(k), i) if s else i) for k, (i, s) in sets.items()), key=str)
    assert got == want


def test_linked_sets_share_enough_signatures():
    """No link of small sets has fewer common signatures than `enough`, from either side; regions find all of them."""
    from lodestone.llm.jaccard_join import Region, Signatures

    rng = np.random.default_rng(12)
    for percent in (80, 90):
        sizes = (4, 21) if percent == 80 else (9, 21)
        bases = [rng.integers(0, 1 << 62, rng.integers(*sizes)).astype(np.uint64) for _ in range(2000)]
        pairs = [np.unique(x) for b in bases for x in (b, np.append(b, rng.integers(0, 1 << 62, dtype=np.uint64)))]
        keys, offsets = np.concatenate(pairs), np.concatenate([[0], np.cumsum([len(s) for s in pairs])])
        sigs = Signatures(keys, offsets, percent)
        entry = {(s, l): (n, sigs.found[a:b]) for s, l, n, a, b in zip(sigs.set, sigs.level, sigs.need, sigs.bounds, sigs.bounds[1:], strict=False)}
        for i in range(0, len(pairs), 2):
            met = [l for s, l in entry if s == i and (i + 1, l) in entry] if i < 40 else [l for l in range(12) if (i, l) in entry and (i + 1, l) in entry]
            # At one level at least, both share as many as either needs.
            assert any(len(np.intersect1d(entry[i, l][1], entry[i + 1, l][1])) >= max(entry[i, l][0], entry[i + 1, l][0]) for l in met)
        r = Region(keys, offsets, percent)
        r.join(np.arange(len(pairs)))
        assert (r.root[::2] == r.root[1::2]).all()


def test_jaccard_join_small_sets(spark):
    """Five words in one of three parts, in groups where more than eight supersets of six words, the sixth in another part, share that part."""
    from lodestone.llm import byte_arrays as ba
    from lodestone.llm.jaccard_join import shingles

    def part(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(ba.mix(shingles(data, np.array([0, len(data)]), 1)[0] ^ np.uint64(0x5851F42D4C957F2D))[0] % np.uint64(3))

    words = {p: [w for w in (f"w{i}" for i in range(200)) if part(w) == p] for p in (0, 1)}
    docs = [words[0][:5], *([*words[0][:5], w] for w in words[1][:12])]
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(docs)], "doc_id bigint, text string").repartition(4)
    assert {r.component_id for r in jaccard_join(df, 1, 80).collect()} == {0}


def test_near_duplicates_go(spark, edge, empty):
    kept = {r.doc_id for r in drop_near_duplicates(edge).collect()}
    assert 5 in kept and not kept & {6, *range(10, 18)} and {1, 2, 61, 62, 63} <= kept and drop_near_duplicates(edge).columns == edge.columns
    assert jaccard_join(empty).count() == drop_near_duplicates(empty).count() == 0


def test_region_join_recursive():
    """Voronoi regions, windows and the pairs that no pivot tells apart, against all pairs."""
    from lodestone.llm.jaccard_join import Region

    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 40, 60)
        for _ in range(rng.integers(1, 9)):
            s = base.copy()
            s[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(0, 1 << 40)
            sets.append(np.unique(s))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    r = Region(np.concatenate(sets).astype(np.uint64), offsets, 80)
    r.join(np.arange(len(sets)))
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(np.intersect1d(a, sets[j]))
            if 100 * inter >= 80 * (len(a) + len(sets[j]) - inter):
                x, y = want[i], want[j]
                want = [min(x, y) if w in (x, y) else w for w in want]
    least: dict[int, int] = {}
    for i, root in enumerate(r.root.tolist()):
        least.setdefault(root, i)
    assert [least[root] for root in r.root.tolist()] == want


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_of_one_sum_are_told_apart(spark, size):
    """Two words whose bytes alternate as in the Thue-Morse sequence have the same polynomial hash modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, f"{word} x y"), (4, f"{other} x y")], "doc_id bigint, text string")
    assert sorted(r.component_id for r in jaccard_join(df, 3, 90).collect()) == [1, 2, 3, 4]


# 10


def toxic_texts(rng, n):
    bad = ["idiot", "moron", "scum", "loser"]
    clean = [sentence(rng, rng.randrange(20, 60)) for _ in range(n)]
    toxic = []
    for _ in range(n):
        ws = sentence(rng, rng.randrange(20, 60)).split()
        for _ in range(3):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        toxic.append(" ".join(ws))
    return clean + toxic, [0] * n + [1] * n


def test_toxicity(spark, edge, empty):
    rng = random.Random(9)
    s = X.Settings(buckets=1 << 14)
    model = X.SubwordModel.fit(*toxic_texts(rng, 300), s)
    texts, labels = toxic_texts(rng, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in X.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in enumerate(labels)]) > 0.95
    clean = sentence(rng, 30)
    assert model.scorer().scores([clean + " idiott morron loserr"])[0] > model.scorer().scores([clean])[0] + 0.2
    assert X.score(edge, model).count() == edge.count() and X.score(empty, model).count() == 0
    kept = X.drop_toxic(df, model, 0.5)
    assert kept.columns == df.columns and kept.count() == sum(v < 0.5 for v in got.values())
    assert np.allclose(X.SubwordModel.fit([], []).scorer().scores(["", "x"]), 0.5)


def test_word_scores_are_those_of_averaged_vectors():
    """The table of words against the definition: n-grams cut by hand, vectors averaged, softmax of two logits."""
    s = X.Settings(buckets=1 << 12, epochs=3)
    texts, labels = toxic_texts(random.Random(11), 60)
    model = X.SubwordModel.fit(texts, labels, s)

    def bucket(gram):
        symbols = [int(X.ba.mix(np.array([ord(c) + 1], np.uint64))[0]) for c in gram]
        h = sum(x * pow(X.ba._BASE, i, 1 << 64) for i, x in enumerate(symbols)) % (1 << 64)
        return int(X.ba.mix(np.array([h], np.uint64))[0]) % s.buckets

    def brute(text):
        words = text.lower().split()
        total, weight = np.zeros(s.dim), float(s.padding)
        for w in set(words):
            full = f"<{w}>"
            grams = [full] + [full[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(full) - n + 1)]
            share = np.sqrt(words.count(w))
            total += share * np.mean([model.vectors[bucket(g)] for g in grams], 0)
            weight += share
        logits = total / weight @ model.weights + model.bias
        p = np.exp(logits - logits.max())
        return p[1] / p.sum()

    probes = [*texts[:5], *texts[-5:], "", " \n", "a", "Idiott zażółć 漢字 漢字 idiott"]
    assert np.allclose(model.scorer().scores(probes), [brute(x) for x in probes], atol=1e-5)


def test_held_out_fold_and_sample(spark):
    from pyspark.sql import functions as F

    from lodestone.llm.folds import fitted, held_out, labelled_sample

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    out = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect()}
    assert out == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = labelled_sample(docs, labels, "toxic", 50).collect()
    texts, ys = [r.text for r in rows], [r.y for r in rows]
    assert sorted(fitted(labelled_sample(docs, labels, "toxic", 50), lambda t, y: t)) == sorted(texts)
    assert fitted(labelled_sample(docs, labels.limit(0), "toxic", 50), lambda t, y: t) == []
    assert len(texts) == 50 and not {int(t[1:]) for t in texts} & out and all(y == int(t[1:]) % 2 for t, y in zip(texts, ys, strict=True))


def test_names_that_clash_are_told_apart(spark, monkeypatch):
    """Rows whose first names are all equal keep their own spans."""
    from lodestone.llm import suffix_dedup

    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"one {passage} tail"), (2, f"another beginning {passage}"), (3, "nothing of it " * 3), (4, "x" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_digests(df).collect()}
    other = suffix_dedup._names
    monkeypatch.setattr(suffix_dedup, "_names", lambda i, x: [F.lit(7).cast("long"), other(i, x)[1]])
    assert suffix_dedup._clashes(df, "doc_id", "text") == [7]
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_digests(df).collect()} == want
    assert want[1][1] > 0 and want[3][1] == 0


def test_long_texts_are_not_fitted_on(spark):
    from lodestone.llm.folds import labelled_sample

    docs = spark.createDataFrame([(i, "é" * (10 * i)) for i in range(1, 30)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    sizes = [len(r.text.encode()) for r in labelled_sample(docs, labels, "toxic", 100, most_bytes=200).collect()]
    assert sizes and max(sizes) <= 200


def test_near_duplicates_by_ids_of_any_type(spark):
    """String ids in their own order, null and repeated ones: the same components as by their places."""
    from lodestone.llm import jaccard_join as J

    rng = random.Random(21)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    rows = []
    for k in range(40):
        text = base[k % 6] if k % 3 else base[k % 6].replace("w1", f"x{k}", 1)
        rows.append((rng.randrange(10_000), text))
    rows += [(10_001, None), (10_002, ""), (rows[0][0], base[1]), (None, base[2])]
    order = sorted({i for i, _ in rows if i is not None}, key=str)
    longs = spark.createDataFrame([(None if i is None else order.index(i), x) for i, x in rows], "doc_id long, text string")
    texts = spark.createDataFrame([(None if i is None else str(i), x) for i, x in rows], "doc_id string, text string").repartition(5)
    name = lambda i: None if i is None else str(order[i])
    want = sorted(((name(r.doc_id), r.n_shingles, name(r.component_id)) for r in J.jaccard_join(longs).collect()), key=str)
    assert sorted((tuple(r) for r in J.jaccard_join(texts).collect()), key=str) == want
    assert any(a != c for a, _, c in want if a is not None)
    kept = sorted((str(r.doc_id) for r in J.drop_near_duplicates(texts).collect()))
    assert kept == sorted(str(name(r.doc_id)) for r in J.drop_near_duplicates(longs).collect()) and len(kept) < len(rows)
