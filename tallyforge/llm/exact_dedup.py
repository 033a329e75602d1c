"""Exact deduplication against immutable snapshots that static binary fuse filters screen.

Texts are equal when identical after lower-casing A-Z only. A snapshot is a batch of documents with its digest groups
and, for each digest shard, a filter; both are written once and never changed. A new batch is first grouped by digest
on its own; only groups that a snapshot's filters let through join its exact buckets. Within the batch as across
snapshots, the texts of every bucket of several rows are compared byte by byte before the batch is taken in.

Defined cases: a null text is empty; of equal texts the row with the largest doc_id stays; a row without doc_id stays
only if no equal row has one; rows repeated with one doc_id share their flag (:func:`keep` leaves one of them); an
empty table gives no rows; other columns do not matter, whatever they are called.
"""

from __future__ import annotations

import functools
import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import fuse_filter
from ._spark import free, stored

KEYS_PER_SHARD = 1 << 16
#: Rows of one digest are dealt to so many keys where texts are compared.
SALTS = 16
#: Bits of the marks that say map-side which texts are not looked for, 8 MB at most; where they fill up, fewer are told.
MARK_BITS = 26
_GROUP = "digest string, keep_id long, n long"


def normalised(text: str | Column) -> Column:
    """The text with A-Z lower-cased; where all of it is ASCII, that is what lower() does, and faster."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest(text: str | Column) -> Column:
    # coalesced, as Spark would else work it out once more to drop nulls in front of a join
    return F.coalesce(F.sha2(normalised(text).cast("binary"), 256), F.lit(""))


@dataclass(frozen=True)
class Snapshot:
    """docs: the batch (doc_id, text); rows: (doc_id, digest); groups: (digest, keep_id, n) of the batch alone; unequal:
    the digests under which texts differ in the batch, or between it and snapshots before it."""

    docs: DataFrame
    rows: DataFrame
    groups: DataFrame
    unequal: DataFrame
    shards: int

    @functools.cached_property
    def filters(self) -> DataFrame:
        """(shard, seed, segment, starts, fingerprints), built and written when a batch is first screened by them."""

        def build(table: pa.Table) -> pa.Table:
            made = fuse_filter.build(table.column("key").to_numpy().view(np.uint64))
            return pa.table({"shard": table.column("shard").slice(0, 1).combine_chunks(), "seed": pa.array([str(made.seed)]), "segment": [made.segment], "starts": [made.starts], "fingerprints": pa.array([made.fingerprints.tobytes()], pa.binary())})

        keys = self.groups.select(_shard(self.shards).alias("shard"), F.xxhash64("digest").alias("key"))
        return stored(keys.groupBy("shard").applyInArrow(build, "shard int, seed string, segment long, starts long, fingerprints binary"), "dedup-filters")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), "digest"), F.lit(shards)).cast("int")


def screened(groups: DataFrame, known: Snapshot) -> DataFrame:
    """The ``groups`` whose digests ``known`` may have; those that its filters hold back it has not."""

    def screen(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(left.num_rows, dtype=bool)
        for f in right.to_pylist():
            hit |= fuse_filter.FuseFilter(int(f["seed"]), f["segment"], f["starts"], np.frombuffer(f["fingerprints"], dtype=np.uint8)).may_contain(left.column("key").to_numpy().view(np.uint64))
        return left.select(["digest", "keep_id", "n"]).filter(pa.array(hit))

    keyed = groups.select("digest", "keep_id", "n", F.xxhash64("digest").alias("key"), _shard(known.shards).alias("shard"))
    return keyed.groupBy("shard").cogroup(known.filters.groupBy("shard")).applyInArrow(screen, _GROUP)


def _salted(digests: DataFrame) -> DataFrame:
    return digests.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def _texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, _salt, _text) of the rows of ``docs`` that have one of the ``digests``.

    The digests' marks, a bit at the place that a digest hashes to, go to all tasks, so that most other texts stay where
    they are; what is left meets the digests themselves, by merge joins at every size.
    """
    place = F.xxhash64(F.lit("mark"), "digest").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    marks = digests.select(place.alias("_place")).groupBy(F.expr("bitmap_bucket_number(_place)").alias("_part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_place))").alias("_bits"))
    rows = docs.select(digest("text").alias("digest"), "text", _salt().alias("_salt")).withColumn("_place", place)
    at = F.expr("bitmap_bit_position(_place)")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.join(F.broadcast(marks), F.expr("bitmap_bucket_number(_place)") == F.col("_part")).filter(F.getbit(byte, (at % 8).cast("int")) == 1)
    return marked.select("digest", "_salt", normalised("text").alias("_text")).join(_salted(digests).hint("merge"), ["digest", "_salt"])


def _different(texts: DataFrame) -> DataFrame:
    """The digests under which texts differ, from the smallest and largest text of each."""
    ends = texts.groupBy("digest", "_salt").agg(F.min("_text").alias("a"), F.max("_text").alias("b"))
    return ends.groupBy("digest").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select("digest")


def ingest(known: Sequence[Snapshot], docs: DataFrame) -> Snapshot:
    """The snapshot of a new batch ``docs`` (doc_id, text) behind the ``known`` ones.

    Texts are compared within the batch's groups of several rows, and with each snapshot's for digests that pass its
    filters and that its buckets have.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(docs.select("doc_id", digest("text").alias("digest")), "dedup-rows")
    groups = stored(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "dedup-groups")
    several = groups.filter("n > 1").select("digest")
    # whole batches whose rows meet: this one's own groups, and for each snapshot the digests that both have
    compared = None
    for old in known:
        met = stored(screened(groups, old).select("digest").join(old.groups.select("digest").hint("merge"), "digest"), "dedup-met")
        several = several.unionByName(met)
        theirs = _texts(old.docs, met)
        compared = theirs if compared is None else compared.unionByName(theirs)
    own = _texts(docs, several.distinct() if known else several)
    unequal = stored(_different(own if compared is None else own.unionByName(compared)), "dedup-different")
    return Snapshot(docs, rows, groups, unequal, max(1, math.ceil(groups.count() / KEYS_PER_SHARD)))


def groups_of(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The table is taken in as ``batches`` successive batches, each screened against the snapshots before it.
    """
    docs = docs.select("doc_id", "text")
    known: list[Snapshot] = []
    for b in range(batches):
        known.append(ingest(known, docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)))
    return merged(known)


def merged(known: Sequence[Snapshot]) -> DataFrame:
    """One row per row of all snapshots: doc_id, keep_id, group_size, kept, text_sha256."""
    all_of = lambda part: functools.reduce(DataFrame.unionByName, [getattr(s, part) for s in known])
    rows, docs = all_of("rows"), all_of("docs")
    groups = all_of("groups").groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    unequal = all_of("unequal").distinct()
    clashes = not unequal.isEmpty()
    plain = groups.join(unequal, "digest", "left_anti") if clashes else groups
    single = plain.filter("n = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", "n", "digest")
    found = rows.withColumn("_salt", _salt()).join(_salted(plain.filter("n > 1")).hint("merge"), ["digest", "_salt"]).select("doc_id", "keep_id", "n", "digest")
    found = single.unionByName(found)
    if clashes:  # equal digests of different texts: their rows are grouped by the texts themselves
        texts = docs.select("doc_id", digest("text").alias("digest"), normalised("text").alias("_text")).join(unequal, "digest")
        own = texts.groupBy("digest", "_text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        found = found.unionByName(texts.join(own, ["digest", "_text"]).select("doc_id", "keep_id", "n", "digest"))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of rows repeated with one doc_id and equal texts."""
    id_, sha, own = free(docs, "dropped_id", "dropped_sha", "digest")
    dropped = groups_of(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    left = docs.withColumn(own, digest("text")).join(dropped, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), "left_anti")
    return left.dropDuplicates(["doc_id", own]).drop(own)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
