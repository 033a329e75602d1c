"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Features are a lower-cased text's runs of 4, 5 and 6 code points, each with the powers of two up to 8 that its count in
the text reaches, hashed into 2**20 places. Each is scaled by the logarithm of its share among toxic texts over that
among the others, both smoothed towards its share among all, so that rare features weigh little, and those of fewer than
LEAST_ROWS texts, which tell nothing of others, are left out; a logistic regression on the scaled features gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _linear

BITS = 20
SIZES = (4, 5, 6)
LEVELS = 4
MAX_TRAIN_ROWS = 8000
THRESHOLD = 0.3
#: Follow-the-regularised-leader: passes over the rows, learning rate, shrinkage of small weights.
EPOCHS, ALPHA, L1 = 8, 2.0, 0.2
#: Of 1, 2, 3, 4, 6, 10 and 16 the one with the least loss under :func:`.validation.cross_validated`, inside the training rows.
LEAST_ROWS = 4
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**32, max(SIZES), dtype=np.uint32) | np.uint32(1)
_LEVEL = np.random.Generator(np.random.PCG64(6)).integers(1, 2**32, LEVELS, dtype=np.uint32)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        codes = np.frombuffer((value.as_py() or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        found, h = [], np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, min(max(SIZES), len(codes)) + 1):
            h = h[: len(codes) - n + 1] + codes[n - 1 :] * _FACTORS[n - 1]
            if n in SIZES:
                found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n))
        runs = np.sort(np.concatenate(found)) if found else h[:0]
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, dtype=np.int64)
        runs, counts = runs[first], np.diff(np.append(first, len(runs)))
        places = [(part ^ (part >> np.uint32(13))) * np.uint32(0xC2B2AE35) for part in (runs[counts >= 1 << k] + _LEVEL[k] for k in range(LEVELS))]
        places = np.sort(np.concatenate(places) >> np.uint32(32 - BITS))
        yield places[np.append(True, places[1:] != places[:-1])] if len(places) else places


def log_count_ratios(rows: list[tuple[int, np.ndarray]], smoothing: float = 10.0) -> np.ndarray:
    counts, rows_of = np.zeros((2, 1 << BITS)), np.zeros((2, 1))
    for y, x in rows:
        counts[y][x] += 1
        rows_of[y] += 1
    usual = (counts.sum(axis=0) + 1) / (rows_of.sum() + 2)
    shares = (counts + smoothing * usual) / (rows_of + smoothing)
    return np.log(shares[1] / shares[0])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> _linear.Model:
    return _linear.fit(docs, labels, features, BITS, max_rows, scale=log_count_ratios, epochs=EPOCHS, alpha=ALPHA, l1=L1, least_rows=LEAST_ROWS)


def classify(docs: DataFrame, model: _linear.Model) -> DataFrame:
    """``docs`` with score and predicted. A null text scores as an empty one; columns so named are replaced."""
    scored = docs.drop("score", "predicted").withColumn("score", _linear.score_column(model, features))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
