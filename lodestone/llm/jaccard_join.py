"""N-gram Jaccard join (operator 9): exact, in metric space.

The Jaccard distance is a metric. Inside a region of documents, pivots create Voronoi regions; a document also goes
to each region whose pivot is at most two radii farther than its own, which the triangle inequality shows to be
enough; the regions join recursively, and small ones directly, by exact set sizes. Regions too large for a task are
divided in this way over the cluster first, others inside their task.

Nearly all documents of a corpus are at distance 1 from each other, where pivots tell nothing apart,
so the outermost regions come from a partition instead, which is exact as well: two
sets of sizes a and b with similarity s or more differ in k = (a + b)(1 - s)/(1 + s) shingles at most, so of k + 1 parts
of the hash space one holds the same shingles of both. Sets that agree on a part are connected; a
connected component is a region, and all links lie inside regions. Each set travels to its region once.

There are more parts than need be, so linked sets agree on many of them. Sets that agree on fewer parts with all others together
than a link takes have no links and go before regions are made (passages that many documents share make no large regions), and
pairs that agree on too few are told apart inside a region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm import byte_arrays as ba
from lodestone.llm.components import components
from lodestone.session import materialize, remove_table

#: Ratio of neighbouring numbers of parts; parts for each that is needed, in percent.
LADDER, SPARE = 1.5, 125
#: Rounds in which sets that meet others too rarely go.
PEELS = 2
#: Sets in which heavy signatures are looked for, and one in how many rows makes one heavy.
SAMPLE, HEAVY = 20_000, 1000
#: Sets that a task remembers having sent.
SEEN = 500_000
#: Shingles of a region that one task joins at most (single documents aside); larger regions are divided.
REGION = 2_000_000
#: Documents compared directly.
LEAF = 64
PIVOTS = 6
#: Times that large regions are divided over the cluster.
ROUNDS = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of some documents, sorted in each, and the offsets of the documents."""
    data = ba.LOWER[data]
    begins, ends, counts = ba.words(data, offsets)
    h = ba.word_hash(data, begins, ends)
    docs = len(offsets) - 1
    n = np.diff(counts)
    doc = np.repeat(np.arange(docs), n)
    place = np.arange(len(h)) - counts[:-1][doc] if len(h) else np.zeros(0, np.int64)
    last = np.minimum(place + width, n[doc]) - place  # words of the shingle that begins here
    starts = np.flatnonzero((last == width) | (place == 0))
    key = np.zeros(len(starts), np.uint64)
    for i in range(width):
        on = last[starts] > i
        key[on] = ba.mix(key[on] * _STEP + h[starts[on] + i] + np.uint64(i + 1))
    doc = doc[starts]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    return key, np.searchsorted(doc, np.arange(docs + 1))


def _sums(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of values by key (halves are added exactly as doubles)."""
    low = np.bincount(key, (values & _LOW).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(key, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def parts_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (a + b) * (100 - percent) // (100 + percent) + 1


def _ladder(most: int) -> np.ndarray:
    steps = [2]
    while steps[-1] < most:
        steps.append(max(steps[-1] + 1, int(steps[-1] * LADDER)))
    return np.array(steps, np.int64)


class Signatures:
    """Signatures of some sets. Entry e is a set at a number of parts: its set, its level, its signatures found[bounds[e] : bounds[e + 1]], and how many
    of them it shares with each partner that it meets there, at least.

    Each set is cut into every number of parts that a partner may need. Empty parts are left out where so many
    parts agree that one of them holds a shingle.
    """

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, percent: int):
        n = np.diff(offsets)
        least, most = -(-n * percent // 100), n * 100 // percent
        low, high = parts_needed(n, least, percent), parts_needed(n, most, percent)
        ladder = _ladder(int(high.max(initial=1)) * SPARE // 100 + 1)
        first, last = (np.searchsorted(ladder, -(-x * SPARE // 100)) for x in (low, high))
        found, entries = [np.zeros(0, np.uint64)], [np.zeros((4, 0), np.int64)]
        for extra in range(int((last - first).max(initial=0)) + 1):
            sets = np.flatnonzero((first + extra <= last) & (n > 0))
            if not len(sets):
                continue
            level = first[sets] + extra
            parts = ladder[level]
            base = np.concatenate([[0], np.cumsum(parts)])
            sizes = n[sets]
            at = np.repeat(offsets[sets] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            member = np.repeat(np.arange(len(sets)), sizes)
            mixed = ba.mix(keys[at] ^ np.uint64(0x5851F42D4C957F2D))
            slot = base[member] + (mixed % parts[member].astype(np.uint64)).astype(np.int64)
            sums = _sums(slot, ba.mix(mixed + _STEP), base[-1])
            filled = np.bincount(slot, minlength=base[-1]) > 0
            owner = np.repeat(np.arange(len(sets)), parts)
            empty = np.bincount(owner, ~filled, len(sets)).astype(np.int64)
            # Pairs of this level need no more parts than these; so many parts agree at least, of which `empty` may be empty.
            agree = parts - np.minimum(high[sets], parts * 100 // SPARE) + 1
            all_sent = empty >= agree
            # A partner with fewer empty parts doesn't send its own: it surely shares one signature, and no more, with a set that sends them.
            need = np.where(all_sent, 1, agree - empty)
            keep = filled | all_sent[owner]
            name = (np.arange(base[-1]) - base[owner]).astype(np.uint64) + (level[owner].astype(np.uint64) << np.uint64(32))
            found.append(ba.mix(sums + ba.mix(name + np.uint64(1)))[keep])
            entries.append(np.stack([sets, level, need, np.bincount(owner, keep, len(sets)).astype(np.int64)]))
        self.set, self.level, self.need, sizes = np.concatenate(entries, 1)
        found = np.concatenate(found)
        order = np.argsort(self.set, kind="stable")
        begins = (np.cumsum(sizes) - sizes)[order]
        self.set, self.level, self.need, sizes = self.set[order], self.level[order], self.need[order], sizes[order]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.found = found[np.repeat(begins - self.bounds[:-1], sizes) + np.arange(self.bounds[-1])]


class Region:
    """Sets that are joined in memory. Links are kept as a forest: two that are linked already need no second look."""

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, percent: int, side: np.ndarray | None = None):
        _, self.items = np.unique(keys, return_inverse=True)
        self.offsets, self.percent, self.side = offsets, percent, side
        self.n = np.diff(offsets)
        self.root = np.arange(len(self.n))
        self.mark = np.zeros(int(self.items.max(initial=-1)) + 1, np.int32)
        self.links: list[tuple[int, int]] = []
        self.trees: dict[int, list[int]] = {}
        self.radius = 1 - percent / 100
        # Documents by signature; `enough`: shared ones that a link takes.
        sigs = Signatures(keys, offsets, percent)
        self.sig_offsets = sigs.bounds[np.searchsorted(sigs.set, np.arange(len(self.n) + 1))]
        self.enough = np.ones(len(self.n), np.int64)
        first = np.searchsorted(sigs.set, np.flatnonzero(self.n))
        if len(first):
            self.enough[self.n > 0] = np.minimum.reduceat(sigs.need, first)
        _, self.sig, counts = np.unique(sigs.found, return_inverse=True, return_counts=True)
        self.sig_bounds = np.concatenate([[0], np.cumsum(counts)])
        self.sig_docs = np.repeat(np.arange(len(self.n)), np.diff(self.sig_offsets))[np.argsort(self.sig, kind="stable")]

    def candidates(self, i: int) -> np.ndarray:
        """Sets that share as many signatures with set i as a link takes."""
        own = self.sig[self.sig_offsets[i] : self.sig_offsets[i + 1]]
        begin, sizes = self.sig_bounds[own], self.sig_bounds[own + 1] - self.sig_bounds[own]
        many = sizes > 1
        begin, sizes = begin[many], sizes[many]
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        found, counts = np.unique(self.sig_docs[at], return_counts=True)
        return found[counts >= self.enough[i]]

    def link(self, i: int, others: np.ndarray) -> None:
        """The smaller one of two trees takes the other's root."""
        for j in others:
            a, b = int(self.root[i]), int(self.root[j])
            if a != b:
                self.links.append((i, int(j)))
                if len(self.trees.setdefault(a, [a])) < len(self.trees.setdefault(b, [b])):
                    a, b = b, a
                self.root[self.trees[b]] = a
                self.trees[a] += self.trees.pop(b)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with others."""
        own = self.items[self.offsets[i] : self.offsets[i + 1]]
        self.mark[own] = 1
        sizes = self.n[others]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.offsets[others] - bounds[:-1], sizes) + np.arange(bounds[-1])
        total = np.concatenate([[0], np.cumsum(self.mark[self.items[at]])])
        self.mark[own] = 0
        return total[bounds[1:]] - total[bounds[:-1]]

    def linked(self, i: int, others: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return others[100 * shared >= self.percent * (self.n[i] + self.n[others] - shared)]

    def distance(self, i: int, others: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return 1 - shared / (self.n[i] + self.n[others] - shared)

    def check(self, i: int, others: np.ndarray) -> None:
        """Links set i with those of others that are near and not linked with it yet."""
        others = others[self.root[others] != self.root[i]]
        if self.side is not None:
            others = others[self.side[others] != self.side[i]]
        others = others[np.minimum(self.n[i], self.n[others]) * 100 >= self.percent * np.maximum(self.n[i], self.n[others])]
        if len(others):
            self.link(i, self.linked(i, others, self.shared(i, others)))

    def join(self, ids: np.ndarray) -> None:
        if len(ids) <= LEAF:
            for k, i in enumerate(ids[:-1]):
                self.check(int(i), ids[k + 1 :])
            return
        # Pivots: each the farthest from those before it.
        table, pivot = np.empty((len(ids), PIVOTS)), int(ids[0])
        for p in range(PIVOTS):
            shared = self.shared(pivot, ids)
            table[:, p] = self.distance(pivot, ids, shared)
            near = self.linked(pivot, ids, shared)
            self.link(pivot, near if self.side is None else near[self.side[near] != self.side[pivot]])
            pivot = int(ids[np.argmax(table[:, : p + 1].min(1))])
        window = table <= table.min(1)[:, None] + 2 * self.radius + 1e-9
        sizes = window.sum(0)
        if sizes.max() <= 0.75 * len(ids) and sizes.sum() <= 2 * len(ids):
            for p in range(PIVOTS):
                self.join(ids[window[:, p]])
            return
        # The windows overlap too much: pairs that neither signatures nor a pivot tell apart are compared. Pairs inside the largest tree need no look.
        place = np.full(len(self.n), -1)
        place[ids] = np.arange(len(ids))
        roots, counts = np.unique(self.root[ids], return_counts=True)
        largest = roots[np.argmax(counts)]
        for i in ids[self.root[ids] != largest]:
            others = place[self.candidates(int(i))]
            others = others[others >= 0]
            others = others[self.root[ids[others]] != self.root[i]]
            if len(others):
                others = others[(np.abs(table[others] - table[place[i]]) <= self.radius + 1e-9).all(1)]
                self.check(int(i), ids[others])


def set_table(df: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, k1 and k2 (128 bits that name the set), levels array<struct<need bigint, sigs array<bigint>>>.

    need: the level, and in the low 32 bits how many signatures a link takes (see Signatures). Equal sets have equal signatures: a task sends them once,
    for the first of them.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = ba.flat(batch.column(1))
            for a, b in ba.pieces(offsets):
                keys, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(b - a), n)
                names = [_sums(doc, ba.mix(keys + np.uint64(s)), b - a).view(np.int64) for s in (1, 2)]
                new = np.zeros(b - a, bool)
                for i, name in enumerate(zip(*(x.tolist() for x in names), strict=True)):
                    if n[i] and name not in seen:
                        new[i] = True
                        seen.add(name)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.where(new, n, 0)
                sigs = Signatures(keys[new[doc]], np.concatenate([[0], np.cumsum(fresh)]), percent)
                found = pa.ListArray.from_arrays(pa.array(sigs.bounds, pa.int32()), pa.array(sigs.found.view(np.int64)))
                entries = pa.StructArray.from_arrays([pa.array(sigs.level << 32 | sigs.need), found], ["need", "sigs"])
                levels = pa.ListArray.from_arrays(pa.array(np.searchsorted(sigs.set, np.arange(b - a + 1)), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *map(pa.array, names), levels], ["doc_id", "n_shingles", "k1", "k2", "levels"])

    return rows.mapInArrow(ba.trimmed(run), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, levels array<struct<need: bigint, sigs: array<bigint>>>")


def _met(batches) -> Iterator[pa.RecordBatch]:
    """Rows (sig, k1, need), sorted: those whose signature several sets have, each set once. Streams; the last row waits for the next one."""
    names = ["sig", "k1", "need"]
    last, joined = [np.zeros(0, np.int64)] * 3, False  # the last row, and whether a set before it has its signature
    for batch in batches:
        rows = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for c, x in zip(names, last, strict=True)]
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [x[new] for x in rows]
        if not len(rows[0]):
            continue
        same = rows[0][1:] == rows[0][:-1]
        keep = np.concatenate([[joined], same]) | np.concatenate([same, [False]])
        last, joined = [x[-1:] for x in rows], bool(keep[-1])
        if keep[:-1].any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in rows], names)
    if joined:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names)


def _joined(width: int, percent: int):
    """Links inside regions, of batches sorted by region, half a and half b: all pairs if a equals b, else those between the halves."""

    def links(rows: list[tuple], blocks: tuple[int, int]) -> pa.RecordBatch | None:
        ids = np.array([r[0] for r in rows], np.int64)
        data, bounds = ba.flat(pa.array([r[1] for r in rows], pa.large_string()))
        parts = [shingles(data[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x], width) for x, y in ba.pieces(bounds)]
        keys = np.concatenate([k for k, _ in parts])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])
        side = np.array([r[2] for r in rows]) if blocks[0] != blocks[1] else None
        region = Region(keys, offsets, percent, side)
        region.join(np.flatnonzero(region.n > 0))
        if not region.links:
            return None
        pairs = ids[np.array(region.links)]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                table = batch.slice(at, 500).to_pydict()
                for region, i, j, block, doc_id, text in zip(*(table[c] for c in ("region", "i", "j", "block", "doc_id", "text")), strict=True):
                    if (region, i, j) != key:
                        if len(rows) > 1 and (found := links(rows, key[1:])) is not None:
                            yield found
                        rows, key = [], (region, i, j)
                    rows.append((doc_id, text, block))
        if len(rows) > 1 and (found := links(rows, key[1:])) is not None:
            yield found

    return run


def _heavy(sets: DataFrame, name: str) -> DataFrame:
    """sig: signatures that more than one in HEAVY of the rows of a sample of sets have; fewer than HEAVY. Which ones are found changes where rows go, not what comes out."""
    share = min(1.0, SAMPLE / max(sets.count(), 1))
    found = sets.sample(share, seed=1).select("k1", F.explode("levels").alias("level")).select(F.explode("level.sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    found = materialize(found.where("m > 1"), f"{name}-counts")
    total = found.agg(F.sum("m").alias("total"))
    heavy = materialize(found.join(F.broadcast(total), F.lit(True)).where(F.col("m") * HEAVY > F.col("total")).select(F.col("sig").alias("heavy")), f"{name}-heavy")
    remove_table(sets.sparkSession, found)
    return heavy


def _several(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows (sig, k1, need) whose signature several sets have, each set once. A heavy signature is never one task: its rows are dealt by signature and set."""
    light = rows.join(F.broadcast(heavy), F.col("sig") == F.col("heavy"), "left_anti").repartition("sig").sortWithinPartitions("sig", "k1")
    hot = rows.join(F.broadcast(heavy), F.col("sig") == F.col("heavy"), "left_semi").dropDuplicates(["sig", "k1"])
    shared = hot.groupBy("sig").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x < y").select(F.col("sig").alias("s"))
    # No more rows than heavy signatures.
    hot = hot.join(F.broadcast(shared), F.col("sig") == F.col("s"), "left_semi")
    return light.mapInArrow(ba.trimmed(_met), "sig bigint, k1 bigint, need bigint").union(hot.select("sig", "k1", "need"))


def _peeled(met: DataFrame, name: str) -> DataFrame:
    """met without the sets that meet others in fewer signatures than a link takes at a level, and without signatures that one set alone has then."""
    enough = met.groupBy("k1", "need").agg(F.count(F.lit(1)).alias("m")).where("m >= (need & 4294967295)").select(F.col("k1").alias("k"), F.col("need").alias("w"))
    left = met.join(enough, (F.col("k1") == F.col("k")) & (F.col("need") == F.col("w")), "left_semi")
    several = left.groupBy("sig").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x < y").select(F.col("sig").alias("s"))
    out = materialize(left.join(several, F.col("sig") == F.col("s"), "left_semi"), name)
    remove_table(met.sparkSession, met)
    return out


def _with_sizes(texts: DataFrame) -> DataFrame:
    """texts with s, the shingles of their region; regions of one document go."""
    sizes = texts.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("m > 1").select(F.col("region").alias("r"), "s")
    return texts.join(sizes, F.col("region") == F.col("r")).select(*texts.columns, "s")


def _distances(width: int, percent: int):
    """Rows sorted by region, pivots first: documents with their distances to the pivots, and whether they are linked."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        region, pivots, bounds = None, np.zeros(0, np.uint64), np.zeros(1, np.int64)
        for batch in batches:
            rows = batch.to_pydict()
            sets = [shingles(*ba.flat(pa.array([x], pa.large_string())), width)[0] for x in rows["text"]]
            out: dict[str, list] = {"pivots": [], "distance": [], "linked": []}
            keep = []
            for i, (r, pivot, own) in enumerate(zip(rows["region"], rows["pivot"], sets, strict=True)):
                if r != region:
                    region, ids, pivots, bounds = r, [], np.zeros(0, np.uint64), np.zeros(1, np.int64)
                if pivot:
                    ids.append(rows["doc_id"][i])
                    pivots, bounds = np.concatenate([pivots, own]), np.append(bounds, len(pivots) + len(own))
                    continue
                both = np.concatenate([[0], np.cumsum(np.isin(pivots, own))])[bounds]
                shared = both[1:] - both[:-1]
                union = len(own) + np.diff(bounds) - shared
                keep.append(i)
                out["pivots"].append(list(ids))
                out["distance"].append((1 - shared / union).tolist())
                out["linked"].append((100 * shared >= percent * union).tolist())
            kinds = {"pivots": pa.list_(pa.int64()), "distance": pa.list_(pa.float64()), "linked": pa.list_(pa.bool_())}
            chosen = batch.select(["region", "doc_id", "n", "text"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, *(pa.array(out[c], k) for c, k in kinds.items())], [*chosen.schema.names, *kinds])

    return run


def _pivoted(large: DataFrame, width: int, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Links between pivots and documents of large regions, and the Voronoi regions with what their windows hold (columns of texts).

    A pair that links lies in the region of the pivot nearest to either one, and in its window of twice the radius. Documents linked with the same pivot need
    no look at each other: of these, only those stay that are within the radius (by their distances to the pivot) of one that isn't linked. All documents are compared
    with the pivots in parts of their region, so that a region is never one task.
    """
    radius = 1 - percent / 100
    chosen = large.groupBy("region", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS)).alias("c")).agg(F.min("doc_id").alias("p")).select(F.col("region").alias("q"), "p")
    pivots = large.join(chosen, (F.col("region") == F.col("q")) & (F.col("doc_id") == F.col("p"))).dropDuplicates(["region", "doc_id"])
    rows = large.select("region", "doc_id", "n", "text", "parts", F.lit(False).alias("pivot"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).alias("part"))
    heads = pivots.select("region", "doc_id", "n", "text", "parts", F.lit(True).alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = rows.unionByName(heads).repartition("region", "part").sortWithinPartitions("region", "part", F.desc("pivot"), "doc_id")
    kept = "region bigint, doc_id bigint, n bigint, text string"
    far = materialize(dealt.drop("parts", "part").mapInArrow(ba.trimmed(_distances(width, percent)), f"{kept}, pivots array<bigint>, distance array<double>, linked array<boolean>"), f"{name}-distances")
    each = far.select("region", "doc_id", "n", "text", F.array_min("distance").alias("least"), F.explode(F.arrays_zip("pivots", "distance", "linked")).alias("p")).select("region", "doc_id", "n", "text", "least", "p.*")
    links = each.where("linked AND doc_id <> pivots").select(F.col("doc_id").alias("a"), F.col("pivots").alias("b"))
    windows = each.where(F.col("distance") <= F.col("least") + 2 * radius + 1e-9)
    others = windows.where("NOT linked").groupBy("region", "pivots").agg(F.min("distance").alias("nearest")).select(F.col("region").alias("r"), F.col("pivots").alias("q"), "nearest")
    left = windows.join(others, (F.col("region") == F.col("r")) & (F.col("pivots") == F.col("q"))).where(~F.col("linked") | (F.col("distance") >= F.col("nearest") - radius - 1e-9))
    return links, left.select(F.xxhash64("region", "pivots").alias("region"), "doc_id", "n", "text")


def _links(texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Links (a, b) inside regions (region, doc_id, n, text); a forest in each that holds all that are linked together.

    Regions of more than REGION shingles are divided by pivots, ROUNDS times at most and for as long as that makes them smaller; what is as large after that goes block by block.
    """
    links: list[DataFrame] = []
    texts = _with_sizes(texts)
    for round_ in range(ROUNDS):
        large = texts.where(F.col("s") > REGION)
        before = large.agg(F.sum("n")).first()[0]
        if not before:
            break
        large = large.withColumn("parts", F.ceil(F.col("s") / REGION).cast("long")).drop("s")
        found, left = _pivoted(large, width, percent, f"{name}-{round_}")
        left = materialize(left, f"{name}-windows")
        links.append(found)
        if (left.agg(F.sum("n")).first()[0] or 0) > 2 * before:
            break
        texts = _with_sizes(texts.where(F.col("s") <= REGION).drop("s").unionByName(left))
    # A region of one block is one group; of g blocks, each document goes to its block and to the g - 1 pairs that the block is in.
    dealt = texts.withColumn("g", F.when(F.col("s") <= REGION, 1).otherwise(F.ceil(F.col("s") * 2 / REGION)).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.expr("sequence(0, g - 1)")))
    dealt = dealt.select("region", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "doc_id", "text")
    dealt = dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "doc_id")
    out = dealt.mapInArrow(ba.trimmed(_joined(width, percent)), "a bigint, b bigint")
    for found in links:
        out = out.union(found)
    return out


def jaccard_join(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", name: str = "jaccard") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Words are runs of other than ASCII white space, A-Z lower-cased; a set holds the distinct shingles of `width` words, or all words
    as one shingle where there are fewer. Two documents link when 100 x intersection >= percent x union. Null and empty texts,
    and those of white space, have an empty set and no link. Rows that share an id are one node, null ids none (their component_id is null
    unless their set equals another's). Ids are of any type that has an order, and smallest by that; other columns are ignored; an empty table gives no rows.

    Equal sets are one node from the start, however many there are. Signatures that a large share of all sets have are dealt by set, and
    Spark splits what is skewed in the joins.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        return _by_place(df, width, percent, id_col, text_col, name)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(set_table(docs, width, percent), f"{name}-sets")
    # Regions, of sets named by k1: a collision only makes a region larger.
    rows = sets.select("k1", F.explode("levels").alias("level")).select("k1", "level.need", F.explode("level.sigs").alias("sig")).select("sig", "k1", "need")
    heavy = _heavy(sets, name)
    met = materialize(_several(rows, heavy), f"{name}-met")
    remove_table(df.sparkSession, heavy)
    for _ in range(PEELS):
        met = _peeled(met, f"{name}-met")
    hubs = met.groupBy("sig").agg(F.min("k1").alias("hub")).select(F.col("sig").alias("s"), "hub")
    stars = met.join(hubs, F.col("sig") == F.col("s")).where("k1 > hub").select(F.col("k1").alias("a"), F.col("hub").alias("b")).distinct()
    near = components(stars, f"{name}-regions")
    remove_table(df.sparkSession, met)
    # The smallest set of a region is in it too.
    regions = materialize(near.union(near.select("component", "component").distinct()).select(F.col("node").alias("k"), F.col("component").alias("region")), f"{name}-near")
    remove_table(df.sparkSession, near)
    groups = sets.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    members = groups.join(regions, F.col("k1") == F.col("k")).select("rep", "region", "n")
    texts = docs.join(members, F.col("doc_id") == F.col("rep")).select("region", "doc_id", "n", "text")
    texts = materialize(texts, f"{name}-texts")
    # Rows that share an id are one node, whatever their sets.
    shared = sets.where("n_shingles > 0").join(groups.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    shared = shared.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a > b").select("a", "b")
    links = components(_links(texts, width, percent, name).union(shared), f"{name}-links")
    for made in (regions, texts):
        remove_table(df.sparkSession, made)
    classes = groups.join(links, F.col("rep") == F.col("node"), "left").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("component", "rep").alias("component")
    )
    out = sets.join(classes, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _by_place(df: DataFrame, width: int, percent: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """jaccard_join() of ids that are no whole numbers: each gets a number in their order, range-partitioned and written, and is told by it afterwards."""
    ids = df.select(F.col(id_col).alias("__id")).where(F.col(id_col).isNotNull()).distinct()
    places = materialize(ids.repartitionByRange("__id").sortWithinPartitions("__id").select("__id", F.monotonically_increasing_id().alias("__n")), f"{name}-ids")
    numbered = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(places, F.col("i") == F.col("__id"), "left").select(F.col("__n").alias("doc_id"), "text")
    found = jaccard_join(numbered, width, percent, name=name)
    of = lambda c: places.select(F.col("__n").alias(f"__{c}"), F.col("__id").alias(c))
    out = found.select(F.col("doc_id").alias("d"), "n_shingles", F.col("component_id").alias("c"))
    out = out.join(of("doc_id"), F.col("d") == F.col("__doc_id"), "left").join(of("component_id"), F.col("c") == F.col("__component_id"), "left")
    return out.select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", name: str = "near") -> DataFrame:
    """The rows of df, with all columns, whose id is the smallest of its component; rows that share that id all stay, and so do rows without an id."""
    found = jaccard_join(df, width, percent, id_col, text_col, name)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)
