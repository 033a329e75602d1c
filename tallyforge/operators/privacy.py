"""Tallies that tell little about any one voter: bounded ballots, calibrated noise, no small numbers, a ledger of the budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranges import running_sums


def bounded(ballots: DataFrame, most: int) -> DataFrame:
    """``ballots`` (election_id, voter_id, choice) with at most one row of a voter in an election, and in at most ``most`` elections.

    Which ones stay follows from digests and not from the order of rows: of an election's ballots of a voter the least
    (choice), of elections those with the least md5 of voter and election. Spark keeps only ``most`` rows of a voter in
    each task before the shuffle. Rows without a voter, election or choice are left out.
    """
    once = ballots.filter("voter_id IS NOT NULL AND election_id IS NOT NULL AND choice IS NOT NULL").groupBy("voter_id", "election_id").agg(F.min("choice").alias("choice"))
    order = Window.partitionBy("voter_id").orderBy(F.md5(F.concat_ws(":", F.col("voter_id").cast("string"), F.col("election_id").cast("string")).cast("binary")), "election_id")
    return once.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).select("election_id", "voter_id", "choice")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the parts' md5."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def geometric_noise(scale: float, *parts: Column) -> Column:
    """Two-sided geometric noise, P(k) in proportion to exp(-|k| / scale): the difference of two geometric numbers."""
    one = lambda side: F.floor(F.log(uniform(F.lit(side), *parts)) * F.lit(-scale))
    return (one("up") - one("down")).cast("long")


def private_tally(ballots: DataFrame, candidates: DataFrame, epsilon: float, most: int, seed: str, least: int = 0) -> DataFrame:
    """(election_id, candidate_id, votes): noisy counts for every candidate of every election, null where below ``least``.

    A voter changes at most ``most`` counts by one, so noise of scale most / epsilon makes the whole release
    epsilon-differentially private. All listed candidates have a number, so that a zero tells nothing, and small numbers
    are hidden by what the noise made of them. ``seed`` is the secret that makes a rerun the same release and not a
    second one: it must not be published, nor used for a release of other ballots.
    """
    if not (epsilon > 0 and most >= 1):
        raise ValueError("epsilon must be positive and most at least 1")
    counts = bounded(ballots, most).groupBy("election_id", F.col("choice").alias("candidate_id")).agg(F.count("*").alias("n"))
    every = candidates.select("election_id", "candidate_id").distinct().join(counts, ["election_id", "candidate_id"], "left")
    noisy = F.coalesce("n", F.lit(0)) + geometric_noise(most / epsilon, F.lit(seed), F.col("election_id"), F.col("candidate_id"))
    return every.select("election_id", "candidate_id", F.when(noisy >= least, noisy).alias("votes"))


def spent(releases: DataFrame, budget: float) -> DataFrame:
    """The ledger ``releases`` (data, release, at, epsilon) with what was spent on the same data up to each and whether it was within ``budget``.

    Releases add up; one that is told twice counts once, with its largest epsilon.
    """
    once = releases.groupBy("data", "release").agg(F.min("at").alias("at"), F.max("epsilon").alias("epsilon"))
    total = F.col("_before") + F.col("epsilon")
    told = running_sums(once, ["data"], ["at", "release"], {"_before": "epsilon"})
    return told.select("data", "release", "at", "epsilon", total.alias("spent"), (total <= F.lit(budget) * (1 + math.ulp(1.0) * 64)).alias("allowed"))
