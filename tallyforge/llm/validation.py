"""Choosing a linear model's settings by cross-validation inside its training rows."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _linear

_RESULT = "setting string, fold long, rows long, positives long, named long, found long, loss double"


def cross_validated(docs: DataFrame, labels: DataFrame, features: _linear.Features, bits: int, settings: Mapping[str, Mapping], max_rows: int, threshold: float, folds: int = 4) -> DataFrame:
    """(setting, fold, rows, positives, named, found, loss): how a model of each setting does on each fold, learnt from the others.

    ``labels`` (doc_id, label 0 or 1) must be training rows only: none that a later test holds out. ``settings`` are
    named arguments of :func:`_linear.train` but for its rows and bits. ``named`` counts the rows of the fold that score at
    least ``threshold``, ``found`` those of them with label 1, ``loss`` is the sum of the rows' logarithmic losses. As in
    :func:`_linear.fit` at most ``max_rows`` labelled rows take part, which bounds what one task holds: the rows of one
    setting and fold. Null labels and ids are left out; of several labels of one id the largest holds.
    """
    sample = (
        labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    fold = F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")), F.lit(folds)).cast("int")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label", fold.alias("own"))

    def extract(batches):
        for batch in batches:
            rows = [x.astype(np.int32).tobytes() for x in features(batch.column("text"))]
            kept = [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), batch.column("own"), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "label", "own", "x"])

    def judge(key, table):
        name, out = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("x", "ascending")])
        rows = [(y, np.frombuffer(x, dtype=np.int32)) for y, x in zip(table["label"].to_pylist(), table["x"].to_pylist(), strict=True)]
        own = table["own"].to_numpy() == out
        model = _linear.train([r for r, o in zip(rows, own, strict=True) if not o], bits, **settings[name])
        y = np.array([r[0] for r, o in zip(rows, own, strict=True) if o], dtype=np.int64)
        p = model.scores(r[1] for r, o in zip(rows, own, strict=True) if o)
        loss = -np.log(np.where(y == 1, p, 1 - p)).sum()
        told = p >= threshold
        row = {"setting": name, "fold": out, "rows": len(y), "positives": int(y.sum()), "named": int(told.sum()), "found": int((told & (y == 1)).sum()), "loss": float(loss)}
        return pa.Table.from_pylist([row])

    runs = F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(f).alias("fold")) for name in settings for f in range(folds)])
    found = chosen.mapInArrow(extract, "doc_id long, label int, own int, x binary").withColumn("_run", F.explode(runs))
    return found.select("doc_id", "label", "own", "x", "_run.setting", "_run.fold").groupBy("setting", "fold").applyInArrow(judge, _RESULT)
