"""Proposals that say the same: groups of embeddings by cosine, through random hyperplanes and an exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import stored
from .graph import components

THRESHOLD = 0.95
#: The chance that a pair right at the threshold shares no bucket; pairs nearer than that are missed less often.
MISS = 1e-4
#: Hyperplanes of a key beyond the logarithm of the number of vectors: a vector then shares a bucket by chance in one of so
#: many bands, as a power of two. Each asks for some more bands, but what only chance brings together moves most often.
SPARE_BITS = 4
#: A key with more rows than this is spread over several tasks; at most MAX_HUBS keys are, so that they can be sent to all.
HUB = 50_000
MAX_HUBS = 20_000
#: Rows of a bucket that the others are compared with in one place.
BLOCK = 2_000
#: Equal vectors are counted in so many parts before they meet.
SALTS = 64
#: Numbers of a batch's products that are held at once.
_PRODUCTS = 1 << 22


def bands_for(threshold: float, bits: int, miss: float = MISS) -> int:
    """How many bands of ``bits`` hyperplanes leave a pair at the threshold apart in all of them with a chance of ``miss`` at most."""
    if not 0 < threshold < 1 or not 0 < miss < 1:
        raise ValueError("threshold and miss must lie between 0 and 1")
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def _keys(bits: int, bands: int, seed: int):
    """A task function: (rep, v) to (rep, keys), a key of ``bits`` sides of hyperplanes for each band."""
    powers = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))

    def of(values: np.ndarray, dims: int) -> np.ndarray:
        planes = np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, bands * bits))
        step = max(1, _PRODUCTS // (bands * bits))
        out = np.empty((len(values), bands), dtype=np.int64)
        for at in range(0, len(values), step):
            part = values[at : at + step]
            scale = np.abs(part).max(axis=1, keepdims=True)
            out[at : at + step] = ((part / scale) @ planes >= 0).reshape(-1, bands, bits) @ powers
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            flat, sizes = np.asarray(lists.values, dtype=np.float64), np.diff(offsets)
            keys = np.empty((len(sizes), bands), dtype=np.int64)
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                keys[rows] = of(flat[offsets[rows][:, None] + np.arange(dims)], int(dims))
            ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["rep", "dims", "keys"])

    return run


def _joined(rows: DataFrame, other: DataFrame, on: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``other``, which has ``on`` at most once; keys that very many rows have are spread over tasks.

    ``sizes`` (``on``, n), if it is known how many rows each key has, saves counting them once more.
    """
    size = max(HUB, math.ceil(rows.count() / MAX_HUBS))
    counts = rows.groupBy(on).agg(F.count("*").alias("_n")) if sizes is None else sizes.select(on, F.col("n").alias("_n"))
    hubs = F.broadcast(counts.filter(F.col("_n") > size).select(on, F.ceil(F.col("_n") / size).cast("int").alias("_salts")))
    zero = F.lit(0).cast("long")
    left = rows.join(hubs, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")), zero)).drop("_salts")
    right = other.join(hubs, on, "left").withColumn("_salt", F.explode(F.sequence(zero, F.coalesce(F.col("_salts") - 1, F.lit(0)).cast("long")))).drop("_salts")
    return left.join(right.hint("merge"), [on, "_salt"], how).drop("_salt")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _confirmed(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b and more) whose vectors' cosine is at least the threshold."""
    side = lambda s: vectors.select(F.col("rep").alias(s), F.col("v").alias(f"_v{s}"), F.col("square").alias(f"_s{s}"))
    met = _joined(_joined(pairs, side("a"), "a"), side("b"), "b")
    near = (F.size("_va") == F.size("_vb")) & (dot("_va", "_vb") >= threshold * F.sqrt(F.col("_sa") * F.col("_sb")))
    return stored(met.filter(near).select(pairs.columns), "similar-links", tidy=True)


def similar_groups(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, bits: int | None = None, seed: int = 11) -> DataFrame:
    """(id, group_id, kept) for each id of ``vectors`` (id, vector): the smallest id of those linked with it, itself included.

    Two are linked if their cosine is at least ``threshold``, which the full vectors decide; vectors of different lengths
    never are. Equal vectors are put together first. Candidates share all ``bits`` (about the logarithm of the number of
    different vectors, and some more) in one of as many bands as the threshold and ``miss`` ask for. In a bucket all are compared with
    its smallest id; once the links found so are groups, whoever is not of the bucket's largest group is compared with
    those of other groups, a block of rows at a time. So a large group of near copies takes time linear in its size, and
    no pair of a bucket is left out that could join two groups.

    Null, empty and zero vectors, and those with null or non-finite entries, are linked with nothing. Null ids are left
    out; of several vectors of one id the smallest holds, whole ones before such as are linked with nothing.
    """
    rows = vectors.filter("id IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("v"))
    huge = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e100))
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & ~huge & F.exists("v", lambda x: F.abs(x) > 1e-100)
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = stored(rows.withColumn("v", F.when(whole, plain)).groupBy("id").agg(F.min("v").alias("v")), "similar-rows", tidy=True)
    kind = dict(rows.dtypes)["id"]

    salted = rows.filter("v IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = stored(salted.groupBy("v", "_salt").agg(F.min("id").alias("rep")), "similar-parts", tidy=True)
    reps = parts.groupBy("v").agg(F.min("rep").alias("rep"))
    members = stored(salted.join(parts.select("v", "_salt").join(reps.hint("merge"), "v").hint("merge"), ["v", "_salt"]).select("id", "rep"), "similar-members", tidy=True)
    texts = stored(reps.select("rep", "v", dot("v", "v").alias("square")), "similar-vectors", tidy=True)

    bits = bits or max(8, min(60, math.ceil(math.log2(max(2, texts.count()))) + SPARE_BITS))
    bands = bands_for(threshold, bits, miss)
    keys = texts.select("rep", "v").mapInArrow(_keys(bits, bands, seed), f"rep {kind}, dims int, keys array<bigint>")
    at = keys.select("rep", "dims", F.posexplode("keys").alias("band", "key")).select("rep", F.xxhash64("dims", "band", "key").alias("bucket"))
    at = stored(at, "similar-buckets", tidy=True)
    firsts = stored(at.groupBy("bucket").agg(F.min("rep").alias("first"), F.count("*").alias("n")).filter("n > 1"), "similar-firsts", tidy=True)
    shared = stored(_joined(at, firsts.select("bucket", "first"), "bucket", sizes=firsts), "similar-shared", tidy=True)
    stars = stored(shared.filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct(), "similar-pairs", tidy=True)
    linked = _confirmed(stars, texts, threshold)

    grouped = components(linked).select(F.col("node").alias("rep"), F.col("component").alias("_group"))
    placed = shared.select("rep", "bucket").join(grouped.hint("merge"), "rep", "left").select("rep", "bucket", F.coalesce("_group", "rep").alias("grp"))
    placed = stored(placed, "similar-placed", tidy=True)
    sizes = placed.groupBy("bucket", "grp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("groups")).filter("groups > 1")
    mixed = stored(mixed.select("bucket", "main", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "similar-mixed", tidy=True)
    open_ = stored(_joined(placed, mixed.drop("n"), "bucket", sizes=mixed), "similar-open", tidy=True)
    asks = open_.filter("grp <> main").select("bucket", F.col("rep").alias("a"), F.col("grp").alias("_ga"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    told = open_.select("bucket", F.col("rep").alias("b"), F.col("grp").alias("_gb"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    pairs = asks.join(told.hint("merge"), ["bucket", "block"]).filter("_ga <> _gb")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("_ga", "_gb").alias("_ga"), F.greatest("_ga", "_gb").alias("_gb")).distinct()
    more = _confirmed(stored(pairs, "similar-pairs", tidy=True), texts, threshold)

    joined = components(more.select(F.col("_ga").alias("a"), F.col("_gb").alias("b"))).select(F.col("node").alias("_group"), F.col("component").alias("_joined"))
    of = texts.select("rep").join(grouped.hint("merge"), "rep", "left").withColumn("_group", F.coalesce("_group", "rep"))
    of = _joined(of, joined, "_group", "left").select("rep", F.coalesce("_joined", "_group").alias("group_id"))
    found = _joined(members, of, "rep").select("id", "group_id")
    alone = rows.filter("v IS NULL").select("id", F.col("id").alias("group_id"))
    return found.unionByName(alone).withColumn("kept", F.col("id") == F.col("group_id"))
