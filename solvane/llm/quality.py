"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are hashed into one table of weights: single words and word pairs, and
singles and pairs of word shapes (lower, capitalised, upper case, with digits,
the same word again; punctuation stands for itself).  A feature's value is its
share of the text's features of that sort, so long and short texts weigh alike.
Training goes over a bounded sample of labelled rows in one task, in an order
fixed by a hash of doc_id; each text updates only the weights that it has (FTRL
with L1 and L2 terms), so the model is sparse.  Scoring is a sparse dot product
inside the scan, without a shuffle.

Defined results: a null or empty text has no features and gets the score of the
intercept; labels that are null are not learned; without any labels every score
is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.shared import only, text_slices, tidy
from solvane.llm.wordhash import WORDS_AND_SIGNS, finish, tokens

#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 8_000
BITS = 18
SCALE = 8.0
_SLICE = 1 << 20


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, leave_fold: int | None = 2) -> DataFrame:
    """At most ``rows`` labelled rows with their texts: (label, mark, text), the least hashes of doc_id first.

    Rows of the fold crc32(doc_id) mod 4 = leave_fold are never among them.
    """
    ids = only(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    if leave_fold is not None:
        ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != leave_fold)
    ids = ids.withColumn("mark", F.xxhash64("doc_id")).dropDuplicates(["doc_id"]).orderBy("mark", "doc_id").limit(rows)
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``rows`` ids, whatever the size of the tables
    return texts.join(F.broadcast(ids), "doc_id").select("label", "mark", "text")


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first feature of each text and their number): hashed n-gram features of texts."""
    t = tokens(texts, WORDS_AND_SIGNS)
    n = len(t.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
    first, last = t.raw[t.start], t.raw[t.start + t.size - 1]
    upper = lambda b: (b >= 65) & (b <= 90)
    shape = np.where(upper(first), np.where((t.size > 1) & upper(last), 3, 2), 1)
    shape = np.where((first >= 48) & (first <= 57) | (last >= 48) & (last <= 57), 4, shape)
    head = np.zeros(n, bool)
    head[t.first[:-1][t.counts() > 0]] = True
    again = np.r_[False, t.hash[1:] == t.hash[:-1]] & ~head
    shaped = np.where(t.kind == 2, t.hash, finish((shape + 8 * again).astype(np.uint64)))
    counts = t.counts()
    with np.errstate(over="ignore"):

        def pairs(h: np.ndarray, salt: int) -> np.ndarray:
            left = np.where(head, np.uint64(salt), np.r_[np.uint64(0), h[:-1]])
            return finish(left * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(salt))

        streams = [t.hash, pairs(t.hash, 11), finish(shaped + np.uint64(23)), pairs(shaped, 37)]
    index = (np.stack(streams, axis=1) >> np.uint64(64 - bits)).astype(np.int64)
    value = np.repeat(SCALE / np.maximum(counts, 1), counts)
    return index.ravel(), np.repeat(value, len(streams)), t.first * len(streams)


def dot(weights: np.ndarray, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of weights times values for each text."""
    total = np.r_[0.0, np.cumsum(weights[index] * value)]
    return total[first[1:]] - total[first[:-1]]


class Ftrl:
    """Follow-the-regularised-leader for logistic loss, with rates for each weight."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the intercept

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def row(self, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text's features with equal indexes added up, and the intercept."""
        at, inverse = np.unique(index, return_inverse=True)
        return np.r_[at, len(self.z) - 1].astype(np.int32), np.r_[np.bincount(inverse, value, len(at)), 1.0].astype(np.float32)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, epochs: int = 2, leave_fold: int | None = 2) -> np.ndarray:
    """Weights, the intercept last; they come to the driver as one bounded row."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(), []
        for b in text_slices(batches, limit=_SLICE):
            index, value, first = features(b.column("text").to_pylist())
            for k, y in enumerate(b.column("label").to_pylist()):
                held.append((*model.row(index[first[k] : first[k + 1]], value[first[k] : first[k + 1]]), y))
        for _ in range(epochs):
            for at, x, y in held:
                model.learn(at, x, y)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})

    sample = sampled(docs, labels, label, rows, leave_fold).repartition(1).sortWithinPartitions("mark", "text")
    made = sample.mapInArrow(tidy(train), "weights binary").first()
    return np.frombuffer(made["weights"], "<f4").astype(np.float64) if made else Ftrl().weights()


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1; all other columns stay."""
    share = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [f for f in docs.schema.fields if f.name != column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = share.value
        for b in text_slices(batches, limit=_SLICE):
            index, value, first = features(b.column("text").to_pylist())
            p = 1 / (1 + np.exp(-np.clip(dot(w, index, value, first) + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(p)], [*(f.name for f in kept), column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(tidy(scored), f"{kinds}, `{column}` double")
