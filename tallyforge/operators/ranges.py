"""Running sums and ranks over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import stored


def running_sums(rows: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each (new column, value column) of ``values``, the sum of the values of the group's rows before it.

    Rows are dealt into ranges of (keys, order), so that a large group lies in many tasks. Sums are formed within each
    range, the ranges' totals are summed before it, and both are added: no window is larger than a range or, of the few
    rows of totals, than the number of ranges. ``order`` must be total within a group for repeatable results.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = stored(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges", tidy=True)
    totals = cut.groupBy("_range", *keys).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values.values())])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *keys, *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(values))])
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(rows.dtypes)
    summed = cut.join(totals, ["_range", *keys])
    return summed.select(
        *rows.columns, *[(F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_b{i}")).cast("long" if kinds[v] in ("int", "bigint") else kinds[v]).alias(name) for i, (name, v) in enumerate(values.items())]
    )


def carried(rows: DataFrame, keys: list[str], order: list[Column], value: str, name: str, largest: bool = False) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null (or, if ``largest``, the greatest) of the group's rows before each.

    As in :func:`running_sums` a group of any size lies in many ranges: what a range ends with is carried to those after
    it, over one row a range. ``order`` must be total within a group for repeatable results.
    """
    take = F.max if largest else (lambda c: F.last(c, ignorenulls=True))
    cut = stored(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "carried", tidy=True)
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    told = cut.withColumn("_within", take(value).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ends = cut.withColumn("_end", take(value).over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_left", F.lead(F.lit(1)).over(within))
    ends = ends.filter("_left IS NULL").select("_range", *keys, "_end")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_range", *keys, take("_end").over(earlier).alias("_before"))
    both = F.greatest("_within", "_before") if largest else F.coalesce("_within", "_before")
    return told.join(ends, ["_range", *keys]).select(*rows.columns, both.alias(name))
