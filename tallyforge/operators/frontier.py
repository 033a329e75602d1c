"""Menus for many options: the ones that no other option beats in cost and benefit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranges import carried


def frontier(options: DataFrame, keys: list[str], cost: str = "cost", benefit: str = "benefit") -> DataFrame:
    """The rows of ``options`` that no other one of their group dominates: none costs as little and brings as much, with one of both better.

    No pairs are formed. In order of cost and, at one cost, of falling benefit an option is on the frontier if its benefit
    exceeds that of all cheaper ones and equals the greatest at its cost; the greatest benefit so far is carried along
    ranges of which a group may have many. Equal options stay together. Rows whose cost or benefit is null or NaN are
    left out.
    """
    known = options.filter(F.col(cost).isNotNull() & F.col(benefit).isNotNull() & ~F.isnan(F.col(cost).cast("double")) & ~F.isnan(F.col(benefit).cast("double")))
    points = known.groupBy(*keys, cost).agg(F.max(benefit).alias(benefit))  # the best at each cost
    best = carried(points, keys, [F.col(cost)], benefit, "_best", largest=True)
    return known.join(best.filter(F.col("_best").isNull() | (F.col(benefit) > F.col("_best"))).drop("_best"), [*keys, cost, benefit], "left_semi")


def menu(options: DataFrame, keys: list[str], status_quo: DataFrame, cost: str = "cost", benefit: str = "benefit") -> DataFrame:
    """The frontier with the status quo, which stays on the menu though it may be dominated, and ``on_frontier``."""
    front = frontier(options.unionByName(status_quo), keys, cost, benefit).distinct().withColumn("on_frontier", F.lit(True))
    missing = status_quo.distinct().join(front.select(*status_quo.columns), status_quo.columns, "left_anti").withColumn("on_frontier", F.lit(False))
    return front.unionByName(missing)
