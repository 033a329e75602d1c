"""What becomes of proposals: intervals of status, votes by the status then valid, pass-through, time to policy, reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import carried

#: The statuses in their order; of two that begin at once the later one holds.
STATUSES = ("draft", "submitted", "voting", "passed", "enacted", "repealed")


def _place(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def changes(history: DataFrame) -> DataFrame:
    """(proposal, at, status) without repeats: one status a moment, and none that already holds.

    ``history`` (proposal, at, status) may come late, repeated and in any order. Rows without one of the three, or with an
    unknown status, are left out.
    """
    known = history.filter("proposal IS NOT NULL AND at IS NOT NULL").withColumn("_place", _place(F.col("status"))).filter("_place > 0")
    moments = known.groupBy("proposal", "at").agg(F.max("_place").cast("int").alias("place"))
    told = carried(moments, ["proposal"], [F.col("at")], "place", "before").filter("before IS NULL OR before <> place")
    return told.select("proposal", "at", F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("place")).alias("status"))


def intervals(history: DataFrame) -> DataFrame:
    """(proposal, status, since, until): from ``since`` on and before ``until``, null while it holds."""
    told = carried(changes(history), ["proposal"], [F.col("at").desc()], "at", "until")
    return told.select("proposal", "status", F.col("at").alias("since"), "until")


def at_the_time(votes: DataFrame, history: DataFrame) -> DataFrame:
    """``votes`` (proposal, voter, at) with the status valid at ``at``, null before the first; a change at that moment holds.

    An as-of join without a join: changes and votes lie in one order, in ranges of which a proposal may have many, and
    each vote takes the status that is carried to it. Votes without a proposal or time have no status.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kinds = dict(votes.dtypes)
    marks = changes(history).select("proposal", F.col("at").cast(kinds["at"]).alias("at"), F.lit(0).alias("_kind"), none(kinds["voter"], "voter"), F.col("status").alias("_mark"))
    cast = votes.select("proposal", "at", F.lit(1).alias("_kind"), "voter", none("string", "_mark"))
    known = cast.filter("proposal IS NOT NULL AND at IS NOT NULL")
    told = carried(marks.unionByName(known), ["proposal"], [F.col("at"), F.col("_kind"), F.col("voter")], "_mark", "status").filter("_kind = 1")
    unknown = cast.filter("proposal IS NULL OR at IS NULL").withColumn("status", F.lit(None).cast("string"))
    return told.select("proposal", "voter", "at", "status").unionByName(unknown.select("proposal", "voter", "at", "status"))


def turnout(votes: DataFrame, history: DataFrame) -> DataFrame:
    """(proposal, status, votes, voters): votes cast while a status was valid, and by how many different voters."""
    return at_the_time(votes, history).groupBy("proposal", "status").agg(F.count("*").alias("votes"), F.count_distinct("voter").alias("voters"))


def outcomes(history: DataFrame) -> DataFrame:
    """(proposal, submitted_at, passed_at, enacted_at, repealed_at) of the proposals that were submitted.

    The first submission, the first passing and enactment, the last repeal; sums by proposal are formed before the shuffle.
    """
    first = lambda s: F.min(F.when(F.col("status") == s, F.col("at")))
    told = history.groupBy("proposal").agg(
        first("submitted").alias("submitted_at"), first("passed").alias("passed_at"), first("enacted").alias("enacted_at"), F.max(F.when(F.col("status") == "repealed", F.col("at"))).alias("repealed_at")
    )
    return told.filter("proposal IS NOT NULL AND submitted_at IS NOT NULL")


def rates(history: DataFrame) -> DataFrame:
    """By year of submission: proposals, passed, enacted, reversed, pass_through, days_to_policy (mean), reversal_rate.

    A step counts if it is not before the one that it follows: passing after submission, enactment after submission,
    repeal after enactment. Rates of none are null.
    """
    told = outcomes(history).select(
        F.year("submitted_at").alias("year"), (F.col("passed_at") >= F.col("submitted_at")).alias("p"), (F.col("enacted_at") >= F.col("submitted_at")).alias("e"),
        ((F.col("enacted_at") >= F.col("submitted_at")) & (F.col("repealed_at") > F.col("enacted_at"))).alias("r"), F.datediff("enacted_at", "submitted_at").alias("days"),
    )
    sums = told.groupBy("year").agg(F.count("*").alias("proposals"), F.count_if("p").alias("passed"), F.count_if("e").alias("enacted"), F.count_if("r").alias("reversed"), F.sum(F.when(F.col("e"), F.col("days"))).alias("days"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.select("year", "proposals", "passed", "enacted", "reversed", share("passed", "proposals").alias("pass_through"), share("days", "enacted").alias("days_to_policy"), share("reversed", "enacted").alias("reversal_rate"))
