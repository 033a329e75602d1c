"""Tiebreaks: functions of the tied candidate ids (in candidate order) and the election id to the winning id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Tiebreak = Callable[[Column, Column], Column]


def lexicographic(tied: Column, election_id: Column) -> Column:
    """The smallest id: the default, so results can be repeated."""
    return F.array_min(tied)


def candidate_order(tied: Column, election_id: Column) -> Column:
    """The tied candidate that was listed first."""
    return F.get(tied, F.lit(0))


def seeded(seed: int) -> Tiebreak:
    """A uniform choice that depends on the seed, the election and the ids alone."""

    def choose(tied: Column, election_id: Column) -> Column:
        return F.array_min(F.transform(tied, lambda c: F.struct(F.xxhash64(F.lit(seed), election_id, c).alias("h"), c.alias("c"))))["c"]

    return choose
