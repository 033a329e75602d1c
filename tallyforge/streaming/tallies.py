"""Running tallies over ballot streams: the methods whose totals add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_choices(ballots: DataFrame, time: str = "ts", late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Plurality votes by window, election and choice; ballots later than the watermark are left out.

    ``ballots`` (election_id, choice, time) may be a stream (append or update mode) or a plain frame.
    """
    cast = ballots.filter("choice IS NOT NULL").withWatermark(time, late)
    counted = cast.groupBy(F.window(time, every), "election_id", F.col("choice").alias("candidate_id")).agg(F.count("*").alias("votes"))
    return counted.select(F.col("window.start").alias("window_start"), "election_id", "candidate_id", "votes")


def windowed_points(ballots: DataFrame, values: str, time: str = "ts", late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Sums of a score or quadratic ballot's map by window, election and candidate."""
    cast = ballots.withWatermark(time, late).select(time, "election_id", F.explode(values).alias("candidate_id", "v"))
    counted = cast.groupBy(F.window(time, every), "election_id", "candidate_id").agg(F.sum(F.col("v").cast("long")).alias("votes"))
    return counted.select(F.col("window.start").alias("window_start"), "election_id", "candidate_id", "votes")
