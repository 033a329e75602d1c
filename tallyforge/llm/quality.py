"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Features are the distinct unigrams and bigrams of a text's tokens, hashed into 2**18 places. A token is a run of
letters and digits or a run of other marks, A-Z lower-cased; a token equal to the one before it is the token "again",
and one in capitals the token "capitals", so that n-grams state repetition and shouting whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _linear, _text

BITS = 18
MAX_TRAIN_ROWS = 8000
THRESHOLD = 0.5
_AGAIN, _CAPITALS = np.uint64(0xA6A1), np.uint64(0xCA95)

#: 0: white space, 1: letters, digits and all beyond ASCII, 2: other marks.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[_text.SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_UPPER[97:123] = -1000


def features(column: pa.Array) -> Iterator[np.ndarray]:
    seen = np.zeros(1 << BITS, dtype=bool)
    for first, end, data, offsets in _text.chunks(column):
        kind = _KIND[data]
        parts = [_text.runs(kind == k, offsets) for k in (1, 2)]
        starts, ends = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        rows = np.searchsorted(offsets, starts, side="right") - 1
        hashes = _text.hash_runs(_text.LOWER[data], starts, ends)
        if len(starts):
            shouted = np.add.reduceat(_UPPER[data], starts)
            # a sum runs up to the next token's start, but white space adds nothing to it
            again = np.zeros(len(starts), dtype=bool)
            again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
            hashes = np.where(shouted > 1, _CAPITALS, hashes)
            hashes[again] = _AGAIN
        pairs = np.zeros(len(hashes), dtype=np.uint64)
        pairs[:-1] = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        one, two = ((_text.mix64(h) >> np.uint64(64 - BITS)).astype(np.int64) for h in (hashes, pairs))
        bounds = _text.row_bounds(rows, end - first)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield _linear.distinct(np.concatenate((one[a:b], two[a : b - 1])) if b > a else one[:0], seen)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> _linear.Model:
    return _linear.fit(docs, labels, features, BITS, max_rows)


def score_column(model: _linear.Model) -> Column:
    return _linear.score_column(model, features)


def classify(docs: DataFrame, model: _linear.Model) -> DataFrame:
    """``docs`` with score and predicted. A null text scores as an empty one; columns so named are replaced."""
    scored = docs.drop("score", "predicted").withColumn("score", score_column(model))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
