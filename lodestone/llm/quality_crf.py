"""Quality classifier (operator 3): a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. A line's features are those of its own
text (shares of kinds of characters, word lengths, repetition) and those of the lines before and after it; the
chain adds what labels follow each other. Forward and backward passes give
each line's marginal, and the mean of the marginals, weighted by line length, is the quality of the document.

Fitted on a bounded sample of labelled documents, whose label counts for each of their lines. Passes run over
many documents at once, one position of the line at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_arrays as ba
from lodestone.llm.folds import fitted, held_out, labelled_sample

THRESHOLD = 0.7
#: Bound on the labelled rows a model is fitted on (a parameter of fit()).
SAMPLE = 4000
#: Kinds of bytes whose share of a line is a feature.
KINDS = [range(65, 91), range(97, 123), range(48, 58), [32, 9], b".,;:'\"()-", b"!", b"|", b"*#$%&@^~_=+<>/\\{}[]`?", range(128, 256)]
OWN = len(KINDS) + 8


@dataclass
class Lines:
    """Lines of some documents, one document after the other."""

    features: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    counts: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Features of all lines (a document without text is one empty line)."""
    newline = np.flatnonzero(data == 10)
    before = np.searchsorted(newline, offsets)
    counts = np.diff(before) + 1
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = int(counts.sum())
    is_first = np.zeros(n, bool)
    is_first[first] = True
    begins, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begins[is_first], begins[~is_first] = offsets[:-1], newline + 1
    is_last = np.zeros(n, bool)
    is_last[first + counts - 1] = True
    ends[is_last], ends[~is_last] = offsets[1:], newline
    lengths = ends - begins
    size = np.maximum(lengths, 1)
    f = np.zeros((n, OWN), np.float32)
    for i, kind in enumerate(KINDS):
        member = np.zeros(256, np.int32)
        member[list(kind)] = 1
        total = np.concatenate([[0], np.cumsum(member[data])])
        f[:, i] = (total[ends] - total[begins]) / size
    # Words: how long, how many like the one before, how many seen already in the line.
    w_begin, w_end, _ = ba.words(data, offsets)
    line = np.searchsorted(begins, w_begin, "right") - 1
    number = np.bincount(line, minlength=n)
    h = ba.mix(ba.span_hash(ba.prefix_hash(ba.BYTE[ba.LOWER[data]]), w_begin, w_end))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    seen = np.zeros(len(h), bool)
    seen[1:] = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])
    words = np.maximum(number, 1)
    upper = (data[w_begin] >= 65) & (data[w_begin] <= 90) if len(w_begin) else np.zeros(0, bool)
    odd = ~((data[w_end - 1] | 32 >= 97) & (data[w_end - 1] | 32 <= 122) | (data[w_end - 1] >= 128)) if len(w_end) else np.zeros(0, bool)
    k = len(KINDS)
    f[:, k] = np.log1p(lengths)
    f[:, k + 1] = np.bincount(line, w_end - w_begin, n) / words / 10
    f[:, k + 2] = np.bincount(line, again, n) / words
    f[:, k + 3] = np.bincount(line[order], seen, n) / words
    f[:, k + 4] = np.bincount(line, upper, n) / words
    f[:, k + 5] = np.bincount(line, odd, n) / words
    f[:, k + 6] = lengths == 0
    f[:, k + 7] = number <= 3
    around = np.zeros((n, 3 * OWN + 3), np.float32)
    around[:, :OWN] = f
    around[1:, OWN : 2 * OWN] = f[:-1]
    around[is_first, OWN : 2 * OWN] = 0
    around[:-1, 2 * OWN : 3 * OWN] = f[1:]
    around[is_last, 2 * OWN : 3 * OWN] = 0
    around[:, -3], around[:, -2], around[:, -1] = is_first, is_last, 1
    return Lines(around, lengths, first, counts)


@dataclass
class LineCrf:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: start[j], then step[i, j]: label j at the first line, and after label i. 0: bad, 1: good.
    chain: np.ndarray

    def unary(self, lines: Lines) -> np.ndarray:
        return ((lines.features - self.center) / self.scale) @ self.weights

    def passes(self, good: np.ndarray, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the forward and backward messages of each line, and each document's partition function."""
        order = np.argsort(-lines.counts, kind="stable")
        first, counts = lines.first[order], lines.counts[order]
        start, step = self.chain[0], self.chain[1:]
        forward, backward = np.zeros((len(good), 2)), np.zeros((len(good), 2))
        score = np.stack([np.zeros(len(good)), good], 1)
        active = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), "left")
        forward[first] = start + score[first]
        for t in range(1, len(active)):
            at = first[: active[t]] + t
            back = forward[at - 1]
            forward[at] = np.logaddexp(back[:, :1] + step[0], back[:, 1:] + step[1]) + score[at]
        for t in range(len(active) - 2, -1, -1):
            at = first[: active[t + 1]] + t
            ahead = backward[at + 1] + score[at + 1]
            backward[at] = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
        ends = lines.first + lines.counts - 1
        return forward, backward, np.logaddexp(forward[ends, 0], forward[ends, 1])

    def marginals(self, lines: Lines) -> np.ndarray:
        """How likely each line is good."""
        forward, backward, total = self.passes(self.unary(lines), lines)
        return np.exp(np.minimum(forward[:, 1] + backward[:, 1] - np.repeat(total, lines.counts), 0))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lines = lines_of(data, offsets)
        weight = lines.lengths + 1.0
        return np.clip(np.add.reduceat(self.marginals(lines) * weight, lines.first) / np.add.reduceat(weight, lines.first), 0, 1)

    @staticmethod
    def fit(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> LineCrf:
        """Adam on the mean log-likelihood of a document's labels, each as heavy as the others. Without labels, every line scores 0.5."""
        width = 3 * OWN + 3
        model = LineCrf(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width), np.zeros((3, 2)))
        if not texts:
            return model
        data, offsets = ba.flat(pa.array(texts, pa.large_string()))
        parts = [lines_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in ba.pieces(offsets)]
        lines = Lines(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("features", "lengths", "first", "counts")))
        lines.first = np.cumsum(lines.counts) - lines.counts
        del parts
        model.center, model.scale = lines.features.mean(0, dtype=np.float64).astype(np.float32), lines.features.std(0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
        model.center[-1], model.scale[-1] = 0, 1
        lines.features -= model.center
        lines.features /= model.scale
        x = lines.features
        y = np.repeat(np.array(labels, np.float64), lines.counts)
        weight = np.repeat(1 / lines.counts, lines.counts)[:, None] / len(texts)
        start = np.zeros(len(y), bool)
        start[lines.first] = True
        pairs = np.flatnonzero(~start)
        told = np.stack([1 - y, y], 1)
        moments = [np.zeros(width), np.zeros(width), np.zeros((3, 2)), np.zeros((3, 2))]
        for i in range(1, rounds + 1):
            good = x @ model.weights
            forward, backward, total = model.passes(good, lines)
            total = np.repeat(total, lines.counts)[:, None]
            p = np.exp(forward + backward - total)
            score = np.stack([np.zeros(len(good)), good], 1)
            ahead = (backward + score)[pairs]
            joint = np.exp(forward[pairs - 1][:, :, None] + model.chain[None, 1:] + ahead[:, None, :] - total[pairs][:, :, None])
            truth = told[pairs - 1][:, :, None] * told[pairs][:, None, :]
            grads = [x.T @ ((p[:, 1] - y) * weight[:, 0]), np.zeros((3, 2))]
            grads[1][0] = ((p - told)[start] * weight[start]).sum(0)
            grads[1][1:] = ((joint - truth) * weight[pairs][:, :, None]).sum(0)
            for value, grad, m, v in ((model.weights, grads[0], *moments[:2]), (model.chain, grads[1], *moments[2:])):
                grad = grad + penalty * value
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                value -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> LineCrf:
    """A model of the labels of at most `rows` labelled rows, none of them of the held-out fold."""
    return fitted(labelled_sample(docs, labels, label, rows), LineCrf.fit)


def score(df: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score double (0 to 1). Null and empty texts are one empty line.

    Ids are passed through, null or repeated; other columns are ignored. Texts of any length are read whole, a few at a time; an empty table gives no rows. What is broadcast is some 70 weights.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = ba.flat(batch.column(1))
            for a, b in ba.pieces(offsets):
                found = model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(ba.trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
