"""The median mechanism: of choices along a line the one that half of the weight lies on either side of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import stored

#: Buckets that a range of values is divided into each round.
BUCKETS = 256


def weighted_median(ballots: DataFrame, value: str = "value", weight: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(election_id, median, total_weight): the least value with at least half of its election's weight at or below it.

    A selection by rounds: sums of weight over ``buckets`` equal parts of the range still open name the part that holds
    the median, whose own least and greatest value are the next range, until both are equal. A round adds up at most
    ``buckets`` sums for an election in each task, however many ballots it has, and ballots outside of the range are left
    behind; no list of values is made. Weights are whole numbers (1 without ``weight``). Ballots without a value (null or
    NaN), or whose weight is null or not positive, are left out; an election of none of the others gives no row; infinite
    values are values like others.
    """
    rows = ballots.select("election_id", F.col(value).cast("double").alias("v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w"))
    rows = rows.filter("v IS NOT NULL AND NOT isnan(v) AND w > 0")
    most = 1.7976931348623157e308
    rows = stored(rows.withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v"))), "median-values", tidy=True)
    state = rows.groupBy("election_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("total")).withColumn("below", F.lit(0).cast("long"))
    state = stored(state, "median-state", tidy=True)
    done = [state.filter("low = high")]
    open_ = state.filter("low < high")
    finite = lambda c: F.greatest(F.least(F.col(c), F.lit(most)), F.lit(-most))
    while not open_.isEmpty():
        met = rows.join(open_.hint("merge"), "election_id").filter("v BETWEEN low AND high")
        # half of each, so that the range of the largest numbers is one; the least and greatest value have a part of their own
        place = F.floor((finite("v") / 2 - finite("low") / 2) / (finite("high") / 2 - finite("low") / 2) * buckets).cast("int")
        place = F.when(F.col("v") == F.col("low"), -1).when(F.col("v") == F.col("high"), buckets).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(buckets - 1)))
        parts = met.groupBy("election_id", place.alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("w"), F.first("total").alias("total"), F.first("below").alias("start"))
        ends = Window.partitionBy("election_id").orderBy("part")
        parts = parts.withColumn("upto", F.col("start") + F.sum("w").over(ends))
        chosen = parts.filter((2 * F.col("upto") >= F.col("total")) & (2 * (F.col("upto") - F.col("w")) < F.col("total")))
        state = stored(chosen.select("election_id", "low", "high", "total", (F.col("upto") - F.col("w")).alias("below")), "median-state", tidy=True)
        done.append(state.filter("low = high"))
        open_ = state.filter("low < high")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("election_id", F.col("low").alias("median"), F.col("total").alias("total_weight"))
