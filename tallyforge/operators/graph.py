"""Connected components of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import stored


def _roots(pointers: DataFrame) -> DataFrame:
    """(node, root) of ``pointers`` (node, root), which lead to ever smaller nodes, followed to their ends by doubling."""
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = stored(pointers.join(ahead.hint("merge"), "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "pointers", tidy=True)
        pointers = moved.select("node", "root")
        if moved.filter("_moved").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it is connected with.

    Each round every node points at its smallest neighbour if that is smaller, pointers are followed to their ends, and
    links are laid between the ends, until none is left. Loops, repeated links and both directions are allowed; links
    with a null end are left out. Rounds are stored, so that a lost executor costs at most one.
    """
    both = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = stored(both, "links", tidy=True)
    known: DataFrame | None = None
    while not both.isEmpty():
        # a node without a smaller neighbour is an end and has no pointer
        found = _roots(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        if known is None:
            ends = both.select(F.col("b").alias("node")).distinct().join(found.hint("merge"), "node", "left_anti")
            known = found.unionByName(ends.select("node", F.col("node").alias("root")))
        else:
            moved = found.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            known = known.join(moved.hint("merge"), "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
        known = stored(known, "components", tidy=True)
        at = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))  # noqa: E731, B023
        laid = both.join(at("a").hint("merge"), "a", "left").join(at("b").hint("merge"), "b", "left")
        laid = laid.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b")
        both = stored(laid.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", tidy=True)
    if known is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return known.select("node", F.col("root").alias("component"))
