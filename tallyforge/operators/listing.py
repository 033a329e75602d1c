"""The list of proposals: filters by domain, program and status, counts for every filter, pages by key, verifiability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spread import spread

#: What a metric needs to count as filled in.
METRIC_PARTS = ("name", "unit", "baseline_val", "baseline_year", "baseline_source", "target_val", "deadline")


def listed(proposals: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, status, created_at, domain_id, program_id): a row for each topic of a proposal, one with nulls if it has none."""
    number = topics.count()
    on = spread(topics.select(F.col("proposal_id").alias("id"), "domain_id", "program_id"), number, "id").distinct()
    return spread(proposals.select("id", "status", "created_at"), number, "id").join(on, "id", "left")


def facets(rows: DataFrame) -> DataFrame:
    """(domain_id, program_id, status, level, n): how many proposals every combination of filters leaves, in one pass.

    A filter that is not set is null; ``level`` has a bit for each (4 domain, 2 program, 1 status), so that it differs
    from topics without a program. A proposal of several topics counts once in each number. The rows of a proposal meet
    once, in as many tasks as their number asks for, and its combinations are told apart there, so that only partial
    counts move afterwards. Null ids count nowhere.
    """
    filters, kinds = ["domain_id", "program_id", "status"], dict(rows.dtypes)
    left = lambda level: [F.lit(None).cast(kinds[c]).alias(c) if level >> (2 - i) & 1 else F.col(c) for i, c in enumerate(filters)]
    every = F.explode(F.array(*[F.struct(*left(level), F.lit(level).cast("long").alias("level")) for level in range(8)])).alias("c")
    met = spread(rows.select("id", *filters), 8 * rows.count(), "id")
    return met.select("id", every).select("id", "c.*").distinct().groupBy(*filters, "level").agg(F.count("id").alias("n"))


def page(rows: DataFrame, size: int, after: tuple | None = None, domain_id=None, program_id=None, status=None) -> DataFrame:
    """(id, status, created_at): the ``size`` newest proposals that the filters leave, behind the last (created_at, id) of the page before.

    A page costs the same however far behind it is: the key is a filter on the scan, each task keeps its ``size`` newest
    and only those meet. Rows without ``created_at`` come last.
    """
    for name, value in (("domain_id", domain_id), ("program_id", program_id), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if after is not None:
        at, last = after
        behind = F.col("created_at").isNull() & (F.col("id") < last) if at is None else F.col("created_at").isNull() | (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last))
        rows = rows.filter(behind)
    return rows.select("id", "status", "created_at").distinct().orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(size)


def verifiability(metrics: Column, scope: Column, items: Column) -> Column:
    """0 to 100: the mean of the share of metrics that are filled in, whether there is a scope, and whether there is a budget.

    No metrics, a blank scope, or no item with amounts that are numbers from 0 up each count as 0.
    """
    present = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""
    all_present = lambda m: F.forall(F.array(*[present(m[part]) for part in METRIC_PARTS]), lambda p: p)
    n = F.greatest(F.coalesce(F.size(metrics), F.lit(0)), F.lit(0))
    filled = F.greatest(F.coalesce(F.size(F.filter(metrics, all_present)), F.lit(0)), F.lit(0))
    share = F.when(n > 0, F.floor(100 * filled / n)).otherwise(0)
    amounts = F.coalesce(F.exists(items, lambda i: (i["one_time_usd"] >= 0) & (i["annual_usd"] >= 0)), F.lit(False))
    return F.floor((share + F.when(present(scope), 100).otherwise(0) + F.when(amounts, 100).otherwise(0)) / 3).cast("int")
