"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact word budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import free, stored

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Between a word's last character and the white space after it.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
ROWS_PER_BUCKET = 512
#: Hex digits of the key that buckets are made of, and so the most bits of a bucket's number: 17 trillion buckets.
KEY_DIGITS = 11


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Each source's word budget. Takes (source, source_size); adds ``target`` double.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``cap`` times its source's size and the excess is shared anew by weight until none is above. That fixpoint is a
    water level: with sources sorted by cap/weight, the level is the largest of (total - caps before k) / (weights
    from k on), so windows over the table of sources give it without iterating.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    before = Window.orderBy((cap * F.col("source_size") / F.col("_w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    return (
        weighed.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(whole))
        .withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.col("_level") * F.col("_w")))
        .drop("_w", "_level")
    )


def sized(docs: DataFrame, key: str, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size``, the number of words of its text, and a hash-random ``key``, of the doc_id if there is one."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    return docs.withColumn("size", word_count("text")).withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), own)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", rows_per_bucket: int = ROWS_PER_BUCKET, key: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken: the words of each document that the mix takes.

    Every row gets a hash-random key. A source's rows are ranged by key into buckets (the key's leading bits, so each
    holds about ``rows_per_bucket`` rows of even the largest source), sums by bucket give each bucket's offset, and a
    window within the bucket gives each row's prefix sum: no task holds a whole source. Offsets are formed in two levels,
    by the leading half of a bucket's bits and within each, so that no task holds all buckets of a source either. A source is taken whole
    floor(budget / size) times; the rest of the budget is cut at its exact word along the key's order.

    Defined cases: a null text is empty (size 0, takes 0); a null source is a source of its own, the last; a null
    doc_id is keyed by its text; repeated rows each count; an empty table gives no rows. Columns of ``docs`` named like
    a result column are replaced, any others are kept, whatever they are called. A bucket holds more rows than
    ``rows_per_bucket`` only where rows share a key, as rows of one doc_id do.

    Texts are counted twice, for the sums and for the rows. With ``key``, docs are what :func:`sized` gave under that
    name, without their texts and perhaps stored, and the key is dropped.
    """
    docs = docs.drop("source_size", "target", "taken", *([] if key else ["size"]))
    if key is None:
        (key,) = free(docs, "key")
        docs = sized(docs, key, seed)
    bucket, offset, own, own_bucket, words, before, epochs, cut = free(docs, "bucket", "offset", "own_source", "own_bucket", "words", "before", "epochs", "cut")
    bits = min(4 * KEY_DIGITS, max(0, math.ceil(math.log2(max(1, docs.count()) / rows_per_bucket))))
    keyed = docs.withColumn(bucket, F.shiftright(F.conv(F.substring(key, 1, KEY_DIGITS), 16, 10).cast("long"), 4 * KEY_DIGITS - bits))
    sums = keyed.groupBy("source", bucket).agg(F.sum("size").alias(words)).withColumn("lead", F.shiftright(bucket, bits - bits // 2))
    sums = stored(sums, "mix-sums")
    leads = stored(sums.groupBy("source", "lead").agg(F.sum(words).alias(words)), "mix-leads")
    sources = targets(leads.groupBy("source").agg(F.sum(words).alias("source_size")), weights, cap)
    earlier = lambda group, by: F.coalesce(F.sum(words).over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leads = leads.select(F.col("source").alias("_source"), F.col("lead").alias("_lead"), earlier(["source"], "lead").alias("_before"))
    within_lead = sums.select(F.col("source").alias(own), "lead", F.col(bucket).alias(own_bucket), earlier(["source", "lead"], bucket).alias("_within"))
    offsets = (
        within_lead.join(leads, F.col(own).eqNullSafe(F.col("_source")) & (F.col("lead") == F.col("_lead"))).withColumn(offset, F.col("_before") + F.col("_within"))
        .select(own, own_bucket, offset).join(sources, F.col(own).eqNullSafe(F.col("source"))).drop("source")
    )
    joined = keyed.join(offsets, F.col("source").eqNullSafe(F.col(own)) & (F.col(bucket) == F.col(own_bucket))).drop(own, own_bucket)
    within = Window.partitionBy("source", bucket).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        joined.withColumn(before, F.col(offset) + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn(epochs, times)
        .withColumn(cut, budget - F.col(epochs) * F.col("source_size"))
        .withColumn("taken", F.col(epochs) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col(cut) - F.col(before))))
        .drop(key, bucket, offset, before, epochs, cut)
    )


def repeated(mixed: DataFrame, epoch: str = "epoch") -> DataFrame:
    """The mix itself: one row per taking of a document, the last one of a source's budget cut after its exact word.

    Takes the result of :func:`mix`; adds ``epoch`` (from 0), replacing a column of that name. A document of which
    nothing is taken gives no row.
    """
    epochs = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    rows = mixed.drop(epoch).filter(F.col("taken") > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), epochs - 1)))
    left = F.col("taken") - F.col(epoch) * F.col("size")
    cut = F.array_join(F.slice(F.split("text", WORD_END), F.lit(1), left.cast("int")), "")
    return rows.withColumn("text", F.when(left >= F.col("size"), F.col("text")).otherwise(cut))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source),
p AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS t, (sum(w) OVER ())::BIGINT AS tw,
    coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
    coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cw
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source ASC NULLS LAST)),
l AS (SELECT *, max((t - 3 * c)::DOUBLE / (tw - cw)::DOUBLE) OVER () AS level FROM p),
g AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * w::DOUBLE) AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM g),
r AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d)
SELECT r.doc_id, r.size, b.source_size, b.target,
  (b.epochs * r.size + greatest(0, least(r.size, b.budget - b.epochs * b.source_size - r.before)))::BIGINT AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
