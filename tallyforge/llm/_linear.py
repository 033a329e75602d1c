"""Hashed sparse linear models: a bounded training sample, follow-the-regularised-leader updates, sparse scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A feature extractor: a string column to one array of distinct feature numbers per row.
Features = Callable[[pa.Array], Iterator[np.ndarray]]


@dataclass(frozen=True)
class Model:
    """``score = sigmoid(bias + sum of the weights of a text's features / sqrt(their number))``; 2**bits weights."""

    weights: np.ndarray
    bias: float

    def scores(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        sums = [float(self.weights[x].sum()) / np.sqrt(max(1, len(x))) for x in rows]
        return 1.0 / (1.0 + np.exp(-np.clip(np.asarray(sums, dtype=np.float64) + self.bias, -30, 30)))


def distinct(codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The distinct values of ``codes``; ``seen`` is an all-False bitmap that is left all False."""
    seen[codes] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class FollowTheLeader:
    """Per-coordinate FTRL-proximal logistic regression on sparse rows."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.where(np.abs(z) <= self.l1, 0.0, np.sign(z) * self.l1 - z)
        return shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        z, n = self.z[at], self.n[at]
        root = np.sqrt(n)
        w = np.copysign(np.maximum(np.abs(z) - self.l1, 0.0), -z) / ((self.beta + root) / self.alpha + self.l2)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        n += g * g
        self.n[at] = n
        self.z[at] = z + g - (np.sqrt(n) - root) / self.alpha * w


def train(rows: list[tuple[int, np.ndarray]], bits: int, scale: Callable[[list], np.ndarray] | None, epochs: int, alpha: float, beta: float, l1: float, l2: float, least_rows: int = 1) -> Model:
    """Fits (label, features) rows. ``scale`` gives each feature's value from the rows; 1 without it.

    Features of fewer than ``least_rows`` rows are left out.
    """
    size = 1 << bits
    if least_rows > 1:
        seen = np.zeros(size, dtype=np.int32)
        for _, x in rows:
            seen[x] += 1
        rows = [(y, x[seen[x] >= least_rows]) for y, x in rows]
    values = scale(rows) if scale else np.ones(size)
    learner = FollowTheLeader(size, alpha, beta, l1, l2)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, x = rows[i]
            learner.learn(np.append(x, size), np.append(values[x] / np.sqrt(max(1, len(x))), 1.0), y)
    w = learner.weights(slice(None))
    return Model((w[:size] * values).astype(np.float32), float(w[size]))


def in_fold(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves ``remainder``; False for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, features: Features, bits: int, max_rows: int, scale=None, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3, least_rows: int = 1) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    Learns from at most ``max_rows`` labelled documents, those whose ids hash lowest: a bounded sample of ids, so it
    is broadcast, the texts are turned into features where they lie, and one task learns from the features. Null
    labels and ids are left out; of several labels of one id the largest holds. Without any row the model scores 0.5.
    """
    sample = (
        labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def extract(batches):
        for batch in batches:
            rows = [x.astype(np.int32).tobytes() for x in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    def learn(batches):
        rows = [(int(y), np.frombuffer(x, dtype=np.int32)) for b in batches for y, x in zip(b.column("label").to_pylist(), b.column("x").to_pylist(), strict=True)]
        model = train(rows, bits, scale, epochs, alpha, beta, l1, l2, least_rows)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    gathered = chosen.mapInArrow(extract, "doc_id long, label int, x binary").repartition(1).sortWithinPartitions("doc_id", "x")
    fitted = gathered.mapInArrow(learn, "weights binary, bias double").collect()
    if not fitted:
        return Model(np.zeros(1 << bits, dtype=np.float32), 0.0)
    return Model(np.frombuffer(fitted[0]["weights"], dtype=np.float32), fitted[0]["bias"])


def score_column(model: Model, features: Features, text: str = "text") -> Column:
    """The model's score of each whole text, 0 to 1; a null text scores as an empty one."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(features(batch)), pa.float64())

    return score(F.col(text))
