"""Centroid clustering (operator 12): k-means over integer vectors with block-norm screening.

A vector's components become integers, packed into bytes beside the norms of its SEGMENTS segments. A centroid has such norms too, and by
Cauchy-Schwarz the squared distance of the two is at least the sum of the squared differences of these norms: eight numbers instead of
all components. Each vector is measured to the centroid whose bound is least; the others get an exact integer distance only where their bound doesn't exceed
that distance.

A round is one Spark job over the packed table: tasks assign their vectors and give the sums of their clusters; Spark adds these up by cluster and
component. What goes to the driver is a row for each of the k x dimensions components, whatever the input, and from there the new centroids go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_arrays as ba
from lodestone.session import materialize

#: The parameters of the contract.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Segments of a vector.
SEGMENTS = 8
#: Sums are sent in limbs of so many bits.
LIMB = 40
#: Vectors worked on at a time.
BATCH = 4096
#: Bounds are lowered by this part of the norms, so that rounding never prunes what is nearest.
SLACK = 1e-9
_MOST = (1 << 63) - 1


def narrow_most(dimensions: int) -> int:
    """Vectors whose integers are at most this are kept as 32-bit numbers and take 64-bit arithmetic, which no squared distance leaves; the others take integers of any size."""
    return 1 << min(27, (61 - dimensions.bit_length()) // 2)


def segment_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row."""
    parts = np.array_split(x.astype(np.float64), min(SEGMENTS, x.shape[1]), axis=1)
    return np.stack([np.sqrt((p * p).sum(1)) for p in parts], 1)


def lower_bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """Least squared distances of rows and centroids that their segment norms allow."""
    apart = norms[:, None, :] - centroid_norms[None]
    return (apart * apart).sum(2) - SLACK * ((norms * norms).sum(1)[:, None] + (centroid_norms * centroid_norms).sum(1)[None])


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, screen: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of integers: the nearest centroid (the smaller number of equals), its squared distance, and how many distances were taken in all."""
    n, k = len(x), len(centroids)
    rows = np.arange(n)

    def distance(on: np.ndarray, j) -> np.ndarray:
        apart = x[on] - centroids[j]
        return (apart * apart).sum(1)

    bounds = lower_bounds(norms, segment_norms(centroids)) if screen else None
    best = bounds.argmin(1) if screen else np.zeros(n, np.int64)
    least = distance(rows, best)
    taken = n
    for j in range(k):
        on = np.flatnonzero((best != j) & (bounds[:, j] <= least.astype(np.float64) if screen else True))
        if len(on):
            d = distance(on, j)
            taken += len(on)
            better = (d < least[on]) | ((d == least[on]) & (j < best[on]))
            best[on[better]], least[on[better]] = j, d[better]
    return best, least, taken


def _packed(dimensions: int, scale: float):
    """Rows (vec_id, e) -> (vec_id, wide, z, norms): the vectors that are kept, as integers; z has 32-bit ones, or decimal text where wide."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "wide", "z", "norms"]
        for batch in batches:
            vectors = batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimensions), False)
            at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            # A component that is null becomes NaN, and goes like one.
            x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dimensions)
            finite = np.isfinite(x).all(1)
            at, x = at[finite], x[finite]
            wide = (np.abs(x) >= narrow_most(dimensions) / scale).any(1)
            z: list[bytes] = [b""] * len(at)
            whole = np.zeros(x.shape, np.int64)
            whole[~wide] = np.floor(x[~wide] * scale).astype(np.int64)
            norms = segment_norms(whole)
            for i in range(len(at)):
                z[i] = b",".join(str(_floor(v, scale)).encode() for v in x[i].tolist()) if wide[i] else whole[i].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(wide), pa.array(z, pa.binary()), pa.array([r.astype("<f8").tobytes() for r in norms], pa.binary())], names)

    return run


def _floor(x: float, scale: float) -> int:
    """floor(scale * x) of doubles; beyond their range, of the exact product."""
    y = scale * x
    if np.isfinite(y):
        return int(np.floor(y))
    top, bottom = x.as_integer_ratio()
    return top * int(scale) // bottom


def _rows(wide: bool, z: list[bytes], norms: list[bytes], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    if wide:
        return np.array([[int(v) for v in r.split(b",")] for r in z], object).reshape(len(z), dimensions), np.zeros((len(z), 1))
    return np.frombuffer(b"".join(z), "<i4").astype(np.int64).reshape(len(z), dimensions), np.frombuffer(b"".join(norms), "<f8").reshape(len(z), -1)


def _assigned(batches, centroids: list[list[int]], dimensions: int) -> Iterator[tuple]:
    """Parts of the batches: (batch, places in it, integers, centroid of each, squared distance of each)."""
    exact = np.array(centroids, object).reshape(-1, dimensions)
    narrow = all(abs(v) <= narrow_most(dimensions) for c in centroids for v in c)
    small = exact.astype(np.int64) if narrow else exact
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH):
            part = batch.slice(begin, BATCH)
            wide = np.array(part.column("wide").to_pylist(), bool)
            for kind in (False, True):
                at = np.flatnonzero(wide == kind)
                if not len(at):
                    continue
                x, norms = _rows(kind, part.column("z").take(pa.array(at)).to_pylist(), part.column("norms").take(pa.array(at)).to_pylist(), dimensions)
                fits = narrow and not kind
                best, least, _ = nearest(x if fits else x.astype(object), norms, small if fits else exact, screen=fits)
                yield part, at, x, best, least


def _sums(centroids: list[list[int]], dimensions: int):
    """One row a task for each cluster, component (-1: the number of vectors) and limb of the sum."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for _, _, x, best, _ in _assigned(batches, centroids, dimensions):
            for j in np.unique(best).tolist():
                own = x[best == j]
                now = total.setdefault(j, [0] * (dimensions + 1))
                for i, v in enumerate([*own.sum(0).tolist(), len(own)]):
                    now[i] += int(v)
        rows = [(j, i if i < dimensions else -1, n, limb) for j, sums in total.items() for i, v in enumerate(sums) for n, limb in enumerate(_limbs(v))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["cluster", "component", "limb", "part"])

    return run


def _limbs(v: int) -> list[int]:
    """Numbers below 2**LIMB whose sum, each shifted by its place, is v; all of its sign."""
    sign, v, out = (-1, -v, []) if v < 0 else (1, v, [])
    while v or not out:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def _final(centroids: list[list[int]], dimensions: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, at, _, best, least in _assigned(batches, centroids, dimensions):
            d = [int(v) if v <= _MOST else None for v in least.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(at)), pa.array(best, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def pack_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, wide, z, norms of the vectors that have so many components, none null or not finite."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    return rows.mapInArrow(ba.trimmed(_packed(dimensions, scale)), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, wide boolean, z binary, norms binary")


def first_centroids(packed: DataFrame, clusters: int, dimensions: int, seed: int) -> list[list[int]]:
    """The vectors whose seed and id have the smallest hashes; those without an id come last, and equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = packed.select(name.alias("h"), "wide", "z", "norms").orderBy(F.col("h").asc_nulls_last(), "wide", "z").limit(clusters).collect()
    return [[int(v) for v in _rows(r.wide, [bytes(r.z)], [bytes(r.norms)], dimensions)[0][0]] for r in found]


def next_centroids(packed: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """Each non-empty centroid becomes the floor of the mean of its vectors, by component."""
    sums = packed.mapInArrow(ba.trimmed(_sums(centroids, dimensions)), "cluster bigint, component bigint, limb bigint, part bigint")
    found: dict[int, dict[int, int]] = {}
    for r in sums.groupBy("cluster", "component", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        of = found.setdefault(r.cluster, {})
        of[r.component] = of.get(r.component, 0) + (int(r.part) << (LIMB * r.limb))
    return [[found[j][i] // found[j][-1] for i in range(dimensions)] if j in found else c for j, c in enumerate(centroids)]


def centroid_clustering(
    df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, name: str = "clustering"
) -> DataFrame:
    """One row per vector that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (array of decimal texts).

    Kept are vectors with so many components, none null or not finite; null vectors and others are left out. Each repeated row counts. Ids may be null
    (their vectors are first centroids only where there are too few others) or repeated. Fewer vectors than clusters make fewer clusters; where several first centroids
    are equal, the smaller number gets all and the others stay. Integers of any size are exact; a squared distance or a sum that exceeds a long is null. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    spark = df.sparkSession
    packed = materialize(pack_vectors(df, id_col, vector_col, dimensions, scale), f"{name}-packed")
    centroids = first_centroids(packed, clusters, dimensions, seed)
    for _ in range(rounds if centroids else 0):
        new = next_centroids(packed, centroids, dimensions)
        if new == centroids:  # further rounds change nothing
            break
        centroids = new
    id_type = packed.schema["vec_id"].dataType.simpleString()
    placed = materialize(packed.mapInArrow(ba.trimmed(_final(centroids, dimensions)), f"vec_id {id_type}, cluster int, distance bigint"), f"{name}-placed")
    exact = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.sum(F.col(c).cast("decimal(38,0)"))).alias("sum")
    own = placed.groupBy("cluster").agg(exact("distance")).select(F.col("cluster").alias("c"), F.expr("try_cast(sum AS bigint)").alias("cluster_inertia"))
    every = placed.agg(exact("distance")).select(F.expr("try_cast(sum AS bigint)").alias("inertia"))
    texts = [[str(v) for v in c] for c in centroids]
    table = spark.createDataFrame([(j, hashlib.sha256(",".join(t).encode()).hexdigest(), t) for j, t in enumerate(texts)], "j int, centroid_sha256 string, centroid array<string>")
    # A row a cluster each, and one.
    out = placed.join(F.broadcast(own), F.col("cluster") == F.col("c")).join(F.broadcast(table), F.col("cluster") == F.col("j")).join(F.broadcast(every), F.lit(True))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def _sql() -> str:
    nearest = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM v JOIN {0} k ON v.i = k.i GROUP BY v.vec_id, k.c) GROUP BY vec_id"
    steps = []
    for n in range(ROUNDS):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(f'c{n}')})")
        steps.append(
            f"c{n + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN ("
            f"SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT a.c, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{n} a JOIN v ON a.vec_id = v.vec_id GROUP BY a.c, v.i)"
            ") m ON k.c = m.c AND k.i = m.i)"
        )
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), v AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT f.c, v.i, v.x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {CLUSTERS}) f JOIN v ON f.vec_id = v.vec_id
), {", ".join(steps)}, placed AS MATERIALIZED ({nearest.format(f"c{ROUNDS}")})
SELECT vec_id, placed.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY placed.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM placed JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c) k ON placed.c = k.c
"""


OP12_SQL = _sql()
