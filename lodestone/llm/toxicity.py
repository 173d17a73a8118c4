"""Toxicity (operator 10): a bag of subword embeddings averaged into a linear softmax.

A word's vector is the mean over its character n-grams (and the word itself), hashed into
buckets; a document's is the mean over its words, each weighted by
the root of its count; a linear softmax follows. Vectors and softmax are
trained together in numpy (minibatches, Adagrad). Misspellings that were never seen share most n-grams
with words that were.

Because everything up to the softmax is a mean, a word adds one number to the
difference of the two logits, so documents are scored from a table of words in one pass, whole texts,
whatever their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_arrays as ba
from lodestone.llm.folds import fitted, held_out, labelled_sample

THRESHOLD = 0.3
#: Bound on the labelled rows a model is fitted on (a parameter of fit()).
SAMPLE = 6000
#: Words whose numbers a worker keeps.
CACHE_ENTRIES = 200_000
#: Of these, those that stay when a task ends.
KEPT = 40_000
#: Words whose n-grams are hashed at a time.
PART = 20_000


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    #: Words without a vector that each text has besides its own, so that a few words alone decide little.
    padding: int = 10
    epochs: int = 10
    batch: int = 64
    rate: float = 6.0
    #: Adagrad's sums of squares begin here; gradients of one subword are some 1e-6.
    floor: float = 1e-9
    seed: int = 7


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, one after the other, and the offset at which each word's begin."""
    text = "".join([f"<{w}>" for w in words])
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if words else np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = ba.prefix_hash(ba.mix(points + np.uint64(1)))
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - begins[owner] if words else np.zeros(0, np.int64)
    owners, keys = [np.arange(len(words))], [ba.mix(ba.span_hash(h, begins, begins + lengths))]
    for n in range(s.shortest, s.longest + 1):
        at = np.flatnonzero(place + n <= lengths[owner])
        owners.append(owner[at])
        keys.append(ba.mix(ba.span_hash(h, at, at + n)))
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return (keys[order] % np.uint64(s.buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class SubwordModel:
    settings: Settings
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> SubwordModel:
        """Without rows of both labels, the scores are the share of label 1 (0.5 without any row)."""
        rng = np.random.default_rng(s.seed)
        y = np.array(labels, np.int64)
        vectors = rng.uniform(-1e-3, 1e-3, (s.buckets, s.dim)).astype(np.float32)
        weights, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
        share = (y.sum() + 1) / (len(y) + 2)
        bias[:] = np.log([1 - share, share])
        if len(set(labels)) < 2:
            return SubwordModel(s, vectors, weights, bias)
        rows = _bags(texts, s)
        weights[:] = rng.normal(0, 0.5, weights.shape)
        squares = [np.full(vectors.shape[0], s.floor, np.float64), np.full(weights.shape, 1e-4), np.full(2, 1e-4)]
        for epoch in range(s.epochs):
            rate = s.rate * (1 - epoch / s.epochs)
            order = rng.permutation(len(rows))
            for at in range(0, len(order), s.batch):
                chosen = order[at : at + s.batch]
                keys = np.concatenate([rows[i][0] for i in chosen])
                shares = np.concatenate([rows[i][1] for i in chosen])
                sizes = [len(rows[i][0]) for i in chosen]
                full = np.flatnonzero(sizes)
                docs = np.zeros((len(chosen), s.dim), np.float32)
                bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                if len(keys):
                    docs[full] = np.add.reduceat(vectors[keys] * shares[:, None], bounds[full])
                logits = docs @ weights + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(chosen)), y[chosen]] -= 1
                p /= len(chosen)
                back = p @ weights.T
                for value, grad, square in ((weights, docs.T @ p, squares[1]), (bias, p.sum(0), squares[2])):
                    square += grad**2
                    value -= (rate * 0.2 * grad / np.sqrt(square)).astype(np.float32)
                owner = np.repeat(np.arange(len(chosen)), sizes)
                grad = np.stack([np.bincount(keys, shares * back[owner, d], s.buckets) for d in range(s.dim)], 1)
                squares[0] += (grad**2).mean(1)
                vectors -= (rate * grad / np.sqrt(squares[0])[:, None]).astype(np.float32)
        return SubwordModel(s, vectors, weights, bias)

    def scorer(self) -> WordScores:
        return WordScores(self.settings, (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def _bags(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets, and the share of its vector that each has."""
    vocabulary: dict[str, int] = {}
    lists = []
    for t in texts:
        counts = Counter(words_of(t))
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in counts], np.int32)
        lists.append((ids, np.fromiter(counts.values(), np.int32, len(counts))))
    names = list(vocabulary)
    del vocabulary
    lengths = np.array([len(w) + 2 for w in names], np.int64)
    bounds = np.concatenate([[0], np.cumsum(1 + sum(np.maximum(lengths - n + 1, 0) for n in range(s.shortest, s.longest + 1)))]) if names else np.zeros(1, np.int64)
    keys = np.empty(bounds[-1], np.int32)
    for at in range(0, len(names), PART):
        found, _ = subwords(names[at : at + PART], s)
        keys[bounds[at] : bounds[at] + len(found)] = found
    del names, lengths
    out = []
    for ids, counts in lists:
        shares = np.sqrt(counts) / (np.sqrt(counts).sum() + s.padding)
        sizes = bounds[ids + 1] - bounds[ids]
        at = np.repeat(bounds[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(ids) else np.zeros(0, np.int64)
        unique, place = np.unique(keys[at], return_inverse=True)
        out.append((unique, np.bincount(place, np.repeat(shares / sizes, sizes), len(unique)).astype(np.float32)))
    return out


class WordScores(dict):
    """Word -> what it adds to the logits' difference; emptied when full."""

    def __init__(self, settings: Settings, numbers: np.ndarray, bias: float):
        super().__init__()
        self.settings, self.numbers, self.bias = settings, numbers, bias

    def __reduce__(self):
        return WordScores, (self.settings, self.numbers, self.bias)

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        keys, bounds = subwords(words, self.settings)
        sums = np.add.reduceat(self.numbers[keys].astype(np.float64), bounds[:-1]) / np.diff(bounds)
        self.update(zip(words, sums.tolist()))

    def shrink(self, most: int = 0) -> None:
        """Leaves the words that were learned first, which are the common ones."""
        if len(self) > most:
            first = list(islice(self.items(), most))
            self.clear()
            self.update(first)

    def scores(self, texts: list[str]) -> np.ndarray:
        lists = [Counter(words_of(t)) for t in texts]
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = list({w for ws in lists for w in ws if w not in self})
        for at in range(0, len(new), PART):
            self.learn(new[at : at + PART])
        get, logits = self.__getitem__, np.full(len(texts), self.bias)
        for i, ws in enumerate(lists):
            if ws:
                shares = np.sqrt(np.fromiter(ws.values(), np.float64, len(ws)))
                logits[i] += shares @ np.fromiter(map(get, ws), np.float64, len(ws)) / (shares.sum() + self.settings.padding)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, settings: Settings = Settings()) -> SubwordModel:
    """A model of the labels of at most `rows` labelled rows, none of them of the held-out fold."""
    return fitted(labelled_sample(docs, labels, label, rows), lambda texts, ys: SubwordModel.fit(texts, ys, settings))


def _scored(spark: SparkSession, model: SubwordModel):
    """text -> score, as a column function; only texts go to the workers, and only numbers come back."""
    shared = spark.sparkContext.broadcast(model.scorer())

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(batches):
            scorer = shared.value
            for batch in batches:
                parts = [scorer.scores([x or "" for x in batch.slice(at, 1000).to_pylist()]) for at in range(0, len(batch), 1000)]
                yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())
            scorer.shrink(KEPT)

        yield from ba.trimmed(run)(batches)

    return scores


def score(df: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score double. Null and empty texts, and those of white space, have the score of the bias.

    Texts of any length are read whole; an empty table gives an empty one. Ids are passed through, null or repeated; other
    columns are ignored. What is broadcast is one number a bucket (0.5 MB).
    """
    return df.select(F.col(id_col).alias("doc_id"), _scored(df.sparkSession, model)(F.col(text_col)).alias("score"))


def drop_toxic(df: DataFrame, model: SubwordModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, whose text scores below threshold; null texts are scored as empty ones and stay null."""
    return df.where(_scored(df.sparkSession, model)(F.col(text_col)) < threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
