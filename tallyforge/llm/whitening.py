"""Whitening of embeddings by MLlib's singular values of centred distributed rows.

Vectors become whole numbers, so that sums and deviations are exact. The distinct ones are the fit list. Its rows less
their mean, formed from exact differences, are a ``RowMatrix``; its singular values s give the eigenvalues s * s / n of
the covariance and its right singular vectors the components. The total variance comes from the exact deviations and not
from the singular values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from ._spark import stored

#: How vectors become whole numbers, and the most components (fixed values).
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Eigenvalues of a d x d Gramian up to d times this share of the largest are rounding of a smaller rank.
_RANK = 2.0**-50


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with x, floor(64 * c) + 1000000 of each entry c, without those whose vector is null or has an entry that is null or not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    entry = lambda c: F.try_add(F.floor(c.cast("double") * SCALE), F.lit(SHIFT).cast("long"))
    rows = embeddings.filter(F.col(vector).isNotNull()).filter(finite).withColumn("x", F.transform(vector, entry))
    return rows.filter(F.forall("x", lambda c: c.isNotNull()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers where they and the sums of their squares fit, Python's otherwise."""
    most = max((max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(0), x.max(0), sums, strict=True)), default=0) if len(x) else 0
    largest = max((abs(s) for s in sums), default=0) + most
    exact = most * most * max(1, len(sums)) < 2**63 and largest < 2**63
    return x * np.int64(n) - np.array(sums, dtype=np.int64) if exact else x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_differences(x, n, sums) / n).astype(np.float64)


def _summed(fit: DataFrame, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> list:
    """The sum over all rows' batches of ``part`` (x), added up within each task and then by place; as long as a part is."""

    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(_matrix(batch.column("x")))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([v if kind == "double" else str(v) for v in total.tolist()])], ["at", "v"])

    parts = fit.select("x").mapInArrow(work, f"at int, v {'double' if kind == 'double' else 'string'}")
    rows = parts.groupBy("at").agg(F.sum(F.col("v").cast("double" if kind == "double" else "decimal(38,0)")).alias("v")).orderBy("at").collect()
    return [r["v"] if kind == "double" else int(r["v"]) for r in rows]


def _column_sums(x: np.ndarray) -> np.ndarray:
    """Sums of 64-bit numbers without overflow: upper and lower halves apart."""
    return (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: key, component, n, deviation, whitened, explained, identity_error.

    Defined cases: rows whose vector is null or has a null or non-finite entry are dropped, as are those with an entry too
    large for a 64-bit whole number and those whose length is not the commonest one (of equally common ones the longest);
    repeated rows each have their result and count once in the fit list; a null key stays; components without variance
    (fewer distinct vectors or dimensions than ``components``, or d * 2^-50 of the largest and less) are left out, so that one distinct vector, vectors without
    entries and an empty table give no rows; a deviation that a long cannot hold is null; other columns do not matter.
    """
    rows = whole_numbers(embeddings.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")), "_vector")
    kind = dict(embeddings.dtypes)[key]
    common = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    d = common["d"] if common else 0
    rows = rows.filter(F.size("x") == d).select("_key", "x")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    sums = _summed(fit, "whole", _column_sums) if d else []
    vectors, values = np.zeros((d, 0)), np.zeros(0)
    if n > 1 and d:
        vectors, values = _components(fit, n, sums, d, components)
    explained, error = [], 0.0
    if len(values):
        total = _summed(fit, "double", lambda x: np.array([(_differences(x, n, sums).astype(np.float64) ** 2).sum()]))[0] / n**3
        explained = [float(e) / total for e in values]
        scale = vectors / np.sqrt(values)
        mean = np.array(_summed(fit, "double", lambda x: (_centred(x, n, sums) @ scale).sum(0))) / n

        def products(x: np.ndarray) -> np.ndarray:
            w = _centred(x, n, sums) @ scale - mean
            return (w.T @ w).ravel()

        covariance = np.array(_summed(fit, "double", products)).reshape(len(values), -1) / n
        error = float(np.abs(covariance - np.eye(len(values))).max())
    scale = vectors / np.sqrt(values)

    def work(batches):
        for batch in batches:
            if batch.num_rows and len(values):
                x = _matrix(batch.column("x"))
                diff = _differences(x, n, sums)
                deviation = [v if v < 2**63 else None for v in (diff * diff).sum(1).tolist()]
                flat = ((diff / n).astype(np.float64) @ scale).ravel()
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(values)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(deviation, pa.int64()), whitened], ["_key", "deviation", "w"])

    told = rows.mapInArrow(work, f"_key {kind}, deviation long, w array<double>").select("_key", "deviation", F.posexplode("w").alias("i", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return told.select(
        F.col("_key").alias(key), (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error")
    )


def _components(fit: DataFrame, n: int, sums: list[int], d: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as columns and the covariance's eigenvalues, falling, of at most ``components`` with variance.

    All d singular vectors are asked for, so that MLlib sums the Gramian over the rows and decomposes it to double
    precision; fewer than half of them would be found by iteration to a tolerance.
    """

    def centre(batches):
        for batch in batches:
            flat = _centred(_matrix(batch.column("x")), n, sums).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d), pa.array(flat))], ["y"])

    centred = fit.select("x").mapInArrow(centre, "y array<double>").select(array_to_vector("y").alias("y"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "y")).computeSVD(d, computeU=False)
    s, v = np.array(found.s.toArray()), found.V.toArray()
    kept = min(components, int((s * s > d * _RANK * s[0] * s[0]).sum()) if len(s) and s[0] > 0 else 0)
    return v[:, :kept], s[:kept] ** 2 / n
