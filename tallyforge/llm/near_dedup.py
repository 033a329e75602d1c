"""Near duplicates: MinHash minima, banding, signature and exact checks, star-contracted components.

Documents with 100 * intersection >= percent * union of their sets of five-word shingles are linked. Equal word
sequences are one class, of which the smallest doc_id stands for all. Universal hash minima of a class's shingles form
bands of 5, as many as let a pair at the threshold share none with a probability of ``MISS`` at most: 20 at 85 percent,
29 at 80.

Within a bucket (classes that share a band) no pairs are emitted at first: every class is checked against the
bucket's smallest only, and components are formed. Only buckets that then still hold several components are searched
for links between these, in blocks of bounded size: first by signatures, which tells the classes with any partner to
look at, then with these classes' sets. A bucket of one large group of near copies is done after the first step. Every
link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._spark import free, stored
from .components import components

WORDS, ROWS = 5, 5
MISS = 1e-5
#: Pairs whose signatures agree in fewer places than so many standard deviations below the threshold are not checked.
DEVIATIONS = 5.3
#: A block of an open bucket has about so many classes, or so many bytes of sets.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Pairs of one class are dealt to so many keys where they meet its signature or its set.
SALTS = 32
_SIGNED = "doc_id long, n_shingles long, sequence binary, bands array<long>, signature binary"


class Threshold:
    """What follows from the least similarity, in percent: the bands, the signature bound and the hash functions."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError(f"percent must be from 1 to 100, not {percent}")
        least = percent / 100
        self.percent = percent
        self.bands = math.ceil(math.log(MISS) / math.log1p(-(least**ROWS))) if percent < 100 else 1
        self.hashes = self.bands * ROWS
        self.agree = max(0, math.floor(self.hashes * least - DEVIATIONS * math.sqrt(self.hashes * least * (1 - least))))
        random = np.random.Generator(np.random.PCG64(1234))
        self.a = random.integers(1, 2**63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 2**63, self.hashes, dtype=np.uint64)
        self.band = random.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    out = []
    for first, end, data, offsets in _text.chunks(column):
        hashes, rows, _, _ = _text.words(data, offsets)
        found, at = _text.shingles(hashes, rows, end - first, WORDS)
        bounds = _text.row_bounds(at, end - first)
        out += [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _sign(batches, by: Threshold):
    """doc_id, n_shingles, a digest of the word sequence, band keys and signature; the last three null without words."""
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, offsets in _text.chunks(batch.column("text")):
            n = end - first
            lower = _text.LOWER[data]
            hashes, rows, starts, ends = _text.words(data, offsets)
            found, at = _text.shingles(hashes, rows, n, WORDS)
            bounds = _text.row_bounds(at, n)
            counts = np.array([len(np.unique(found[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.int64)
            some = np.flatnonzero(counts)
            minima = np.empty((by.hashes, len(some)), dtype=np.uint32)
            for k in range(by.hashes) if len(some) else ():
                minima[k] = np.minimum.reduceat((found * by.a[k] + by.b[k]) >> np.uint64(32), bounds[some])
            keys = np.zeros((len(some), by.bands), dtype=np.uint64)
            for r in range(ROWS):
                keys += minima[r::ROWS].T.astype(np.uint64) * by.band[r]
            keys = _text.mix64(keys).view(np.int64)
            signatures = np.ascontiguousarray(minima.T)
            # words joined by one space: everything between words gives way to it
            joined = lower.copy()
            joined[_text.SPACE[lower]] = 32
            spots = _text.row_bounds(rows, n)
            sequence, bands, signature = [None] * n, [None] * n, [None] * n
            keep = np.ones(len(joined), dtype=bool)
            keep[1:] = ~((joined[1:] == 32) & (joined[:-1] == 32))
            for i, r in enumerate(some):
                a, b = starts[spots[r]], ends[spots[r + 1] - 1]
                sequence[r] = hashlib.blake2b(joined[a:b][keep[a:b]].tobytes(), digest_size=16).digest()
                bands[r], signature[r] = keys[i], signatures[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n).cast(pa.int64()), pa.array(counts), pa.array(sequence, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary())],
                ["doc_id", "n_shingles", "sequence", "bands", "signature"],
            )


def _beside(pairs: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``pairs`` (a, b) with ``table``'s value of both as x and y.

    A class may be the ``a`` of very many pairs, so these are dealt to ``SALTS`` keys and its value is copied to those in
    use. By merge joins at every size, as neither side has a bound.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = pairs.select("a", "salt").distinct().join(table.select(F.col(key).alias("a"), F.col(value).alias("x")).hint("merge"), "a")
    both = pairs.join(table.select(F.col(key).alias("b"), F.col(value).alias("y")).hint("merge"), "b")
    return both.join(left.hint("merge"), ["a", "salt"]).drop("salt")


def _agreeing(pairs: DataFrame, signatures: DataFrame, by: Threshold) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``by.agree`` places."""
    hashes = by.hashes

    @F.arrow_udf("int")
    def agree(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(z.to_pylist()), dtype=np.uint32).reshape(-1, hashes) for z in (x, y))
        return pa.array((left == right).sum(axis=1).astype(np.int32))

    return _beside(pairs, signatures, "rep", "signature").filter(agree("x", "y") >= by.agree).select("a", "b")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the members, texts moved once; by a merge join at every size, as ids have no bound."""

    def sets(batches):
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").join(members.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id").mapInArrow(sets, "doc_id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets, as edges (u, v)."""

    def confirm(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (x, y))
                shared = int(_shared(x, y, np.array([0, len(y)]))[0])
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = _beside(pairs, sets, "doc_id", "shingles")
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y").mapInArrow(confirm, "u long, v long")


def _shared(x: np.ndarray, others: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many elements of each of ``others`` (not empty, one after the other) the sorted set ``x`` has."""
    at = np.searchsorted(x, others)
    return np.add.reduceat((x[np.minimum(at, len(x) - 1)] == others).astype(np.int64), bounds[:-1])


def _partners(table: pa.Table, by: Threshold, components: np.ndarray):
    """For each class of a meeting in turn, the later ones that are to be compared with it: (class, their places).

    That is where components, blocks and sizes allow it, signatures agree often enough and this is the first band in
    which the two agree. ``components`` is read anew for each class.
    """
    block, rep, size = (table.column(c).to_numpy() for c in ("block", "rep", "n_shingles"))
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    band = int(table.column("band")[0].as_py())
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, by.bands, ROWS)
    for x in range(len(rep)):
        possible = (components != components[x]) & (rep > rep[x])
        if across:
            possible &= block != block[x]
        possible &= 100 * np.minimum(size, size[x]) >= by.percent * np.maximum(size, size[x])
        at = np.flatnonzero(possible)
        same = signature[at] == signature[x]
        at = at[(same.sum(axis=(1, 2)) >= by.agree) & (same.all(axis=2).argmax(axis=1) == band)]
        if len(at):
            yield x, at


def _across(buckets: DataFrame, reps: DataFrame, sets: DataFrame, found: DataFrame, by: Threshold) -> DataFrame:
    """Pairs of classes in different components that are links, or nearly: a tree per bucket rather than all pairs.

    A bucket is dealt to blocks of about ``BLOCK`` classes, and each two of these meet in one small group. Signatures
    meet first; only classes with a partner to be compared with are met again by their sets. The intersection is
    counted on 32 bits of each shingle, which finds none too few and by chance some too many: pairs clear of the
    threshold join their components for the rest of the group, pairs near to it are all passed on to be confirmed.
    """
    member = buckets.join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    member = member.join(reps.select("rep", "n_shingles"), "rep")
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n_shingles") * 4) / BLOCK_BYTES))
    open_ = member.groupBy("band", "key").agg(size.cast("int").alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band", "key", "blocks")
    rows = member.join(open_, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = stored(rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other"), "near-meetings")

    def halve(batches):
        for batch in batches:
            high = [(np.frombuffer(x, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(high, pa.binary())], ["rep", "high"])

    def look(table: pa.Table) -> pa.Table:
        chosen = np.zeros(table.num_rows, dtype=bool)
        for x, at in _partners(table, by, np.unique(table.column("component").to_numpy(), return_inverse=True)[1]):
            chosen[x] = True
            chosen[at] = True
        return table.filter(pa.array(chosen)).select(names)

    def meet(table: pa.Table) -> pa.Table:
        component = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        rep, size = (table.column(c).to_numpy() for c in ("rep", "n_shingles"))
        high = [np.frombuffer(x, dtype=np.uint32) for x in table.column("high").to_pylist()]
        a, b = [], []
        for x, at in _partners(table, by, component):
            shared = _shared(high[x], np.concatenate([high[y] for y in at]), np.cumsum([0, *[len(high[y]) for y in at]]))
            over = (100 + by.percent) * shared - by.percent * (size[x] + size[at])  # at least 0: a link
            chance = size[x] * size[at] / 2**32  # how many shingles agree on 32 bits by chance
            slack = (100 + by.percent) * (2 + chance + 8 * np.sqrt(chance))
            for y, gain, unsure in zip(at, over, slack, strict=True):
                if gain < -(100 + by.percent) * 2 or component[x] == component[y]:
                    continue
                a.append(rep[x])
                b.append(rep[y])
                if gain >= unsure:
                    component[component == component[y]] = component[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    schema = rows.schema
    names = schema.names
    meeting = ["band", "key", "i", "j"]
    # as many tasks as the session shuffles to: meetings take long for the few bytes that they are
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signatures = reps.select("rep", "signature").hint("merge")
    wanted = stored(rows.join(signatures, "rep").repartition(tasks, *meeting).groupBy(*meeting).applyInArrow(look, schema), "near-wanted")
    if wanted.isEmpty():
        return wanted.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    again = wanted.join(signatures, "rep").join(sets.mapInArrow(halve, "rep long, high binary").hint("merge"), "rep")
    return again.repartition(tasks, *meeting).groupBy(*meeting).applyInArrow(meet, "a long, b long")


def groups_of(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; linked from ``percent`` similarity up.

    Defined cases: fewer than five words make one shingle of all; a text without words (or null) has none and is
    linked with nothing; rows of one doc_id are one node, linked by any of its texts; a row without doc_id is linked
    with nothing, its component_id null, and kept; an empty table gives no rows; other columns do not matter.
    """
    by = Threshold(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(lambda batches: _sign(batches, by), _SIGNED), "near-signed")
    whole = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = whole.groupBy("sequence").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    several = stored(classes.filter("m > 1").drop("m"), "near-classes")
    copies = whole.select("doc_id", "sequence").join(several, "sequence")
    behind = stored(copies.filter("doc_id <> rep").distinct(), "near-copies")
    reps = whole.join(behind, ["doc_id", "sequence"], "left_anti").select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "signature")
    exploded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    centres = exploded.groupBy("band", "key").agg(F.min("rep").alias("centre"), F.max("rep").alias("_last")).filter("centre < _last").drop("_last")
    buckets = stored(exploded.join(centres, ["band", "key"]), "near-buckets")
    stars = buckets.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    sets = stored(_sets(docs, buckets.select("rep").distinct()), "near-sets")
    links = _confirmed(_agreeing(stars, reps, by), sets, percent)
    # a doc_id with several texts holds their classes together
    mixed = whole.groupBy("doc_id").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).filter("low < high").select("doc_id")
    links = stored(links.unionByName(behind.join(mixed, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))), "near-links")
    found = stored(components(links), "near-components")
    more = stored(_across(buckets.drop("centre"), reps, sets, found, by).distinct(), "near-across")
    if not more.isEmpty():
        further = _confirmed(more, sets, percent)
        found = stored(components(further.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))), "near-components")
    node = signed.select("doc_id", "n_shingles").join(behind.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left")
    node = node.withColumn("node", F.coalesce("rep", "doc_id")).drop("rep")
    joined = node.join(found, "node", "left").withColumn("component_id", F.least(F.coalesce("component", "node"), F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns, whatever these are called."""
    (own,) = free(docs, "dropped_id")
    dropped = groups_of(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(own), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 4) END), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) AS s FROM d),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s AS x JOIN s AS y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b FROM r JOIN both_ways ON a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
