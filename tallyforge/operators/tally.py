"""Tallies that add up: plurality, approval, score, Borda and quadratic, for many elections in one job.

Every method is the same plan. Ballots are exploded to (candidate, value) and summed by election and candidate at
once, with map-side partial sums, so a fact row never meets the candidates; the few sums are then joined to the
candidates, which leaves unknown ids out and gives candidates without votes a zero. One row per election, made from
the list of elections, carries the totals, so elections without ballots or candidates have a result too.

With ``weight``, a column of the ballots, every ballot counts that much (a null weight counts 0): votes are sums of
weights, rates are taken of the weight cast, and the header has total_weight and abstained_weight besides the numbers of
ballots. Whole weights give the same sums in any order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ballots as B
from ..functions.tiebreak import Tiebreak, lexicographic

KEY = ["election_id", "candidate_id"]


@dataclass(frozen=True)
class Result:
    """header: one row per election; counts: one per candidate; others by name (rounds, edges, matrix)."""

    header: DataFrame
    counts: DataFrame
    more: dict[str, DataFrame] = field(default_factory=dict)

    def to_dict(self, election_id: str) -> dict:
        """One election's result as plain values, for interactive use and tests."""
        head = self.header.filter(F.col("election_id") == election_id).first()
        rows = [r.asDict() for r in self.counts.filter(F.col("election_id") == election_id).collect()]
        return (head.asDict(recursive=True) if head else {}) | {"counts": {r["candidate_id"]: r for r in rows}}


def all_elections(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None) -> DataFrame:
    named = ballots.select("election_id").unionByName(candidates.select("election_id"))
    return (named if elections is None else named.unionByName(elections.select("election_id"))).distinct()


def duplicate_candidates(candidates: DataFrame) -> DataFrame:
    """Candidate ids listed more than once in an election; resolving such an election is not defined."""
    return candidates.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def of(weight: str | None) -> Column:
    """What a ballot counts."""
    return F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0))


def _number(weight: str | None) -> Column:
    """The sum of what a group's ballots count."""
    return F.count("*") if weight is None else F.sum(of(weight))


def _cast(weight: str | None) -> Column:
    """What the ballots that are no abstentions count, of a header."""
    return F.col("total_ballots") - F.col("abstentions") if weight is None else F.col("total_weight") - F.col("abstained_weight")


def _kept(*columns: str, weight: str | None) -> list[str]:
    return ["election_id", *columns, *([weight] if weight else [])]


def zero_filled(candidates: DataFrame, sums: DataFrame) -> DataFrame:
    """A row per candidate; a sum that is missing is 0."""
    columns = [c for c in sums.columns if c not in KEY]
    joined = candidates.select(*KEY, "ord").join(sums, KEY, "left")
    kinds = dict(sums.dtypes)
    return joined.select(*KEY, "ord", *[F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in columns])


def tied_at_top(counts: DataFrame, value: str) -> DataFrame:
    """Per election the candidates at the highest ``value``, in candidate order."""
    entry = F.struct(F.col("ord").alias("o"), F.col("candidate_id").alias("c"), F.col(value).alias("v"))
    lists = counts.groupBy("election_id").agg(F.array_sort(F.collect_list(entry)).alias("l"), F.max(value).alias("top"))
    return lists.select("election_id", F.transform(F.filter("l", lambda x: x["v"] == F.col("top")), lambda x: x["c"]).alias("tied"))


def with_winner(header: DataFrame, tied: DataFrame, tiebreak: Tiebreak) -> DataFrame:
    """Adds winners (none, or one) and tiebreak_applied, true where several candidates were tied."""
    joined = header.join(tied, "election_id", "left").withColumn("tied", F.coalesce("tied", F.array().cast("array<string>")))
    several = F.size("tied") > 1
    return (
        joined.withColumn("winners", F.when(several, F.array(tiebreak(F.col("tied"), F.col("election_id")))).otherwise(F.col("tied")))
        .withColumn("tiebreak_applied", several)
        .drop("tied")
    )


def _header(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None, abstains: Column, weight: str | None = None, **more: Column) -> DataFrame:
    weights = {"total_weight": F.sum(of(weight)), "abstained_weight": F.sum(F.when(abstains, of(weight)).otherwise(F.lit(0)))} if weight else {}
    counted = ballots.groupBy("election_id").agg(F.count("*").alias("total_ballots"), F.count_if(abstains).alias("abstentions"), *[c.alias(k) for k, c in (weights | more).items()])
    kinds = dict(counted.dtypes)
    joined = all_elections(ballots, candidates, elections).join(counted, "election_id", "left")
    return joined.select("election_id", *[F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in counted.columns[1:]])


def plurality(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None = None, tiebreak: Tiebreak = lexicographic, weight: str | None = None) -> Result:
    """Votes per candidate; a choice that is no candidate is neither a vote nor an abstention."""
    sums = ballots.filter("choice IS NOT NULL").groupBy("election_id", F.col("choice").alias("candidate_id")).agg(_number(weight).alias("votes"))
    counts = zero_filled(candidates, sums)
    header = _header(ballots, candidates, elections, B.is_single_abstention(), weight)
    return Result(with_winner(header, tied_at_top(counts, "votes"), tiebreak), counts)


def approval(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None = None, tiebreak: Tiebreak = lexicographic, weight: str | None = None) -> Result:
    """Approvals per candidate, their rate and the mean number per ballot; ballots with unknown ids alone count as cast."""
    ids = F.explode(F.array_distinct("approvals")).alias("candidate_id")
    counts = zero_filled(candidates, ballots.select(*_kept(weight=weight), ids).groupBy(*KEY).agg(_number(weight).alias("votes")))
    header = _header(ballots, candidates, elections, B.is_list_abstention("approvals"), weight)
    cast = _cast(weight)
    counts = counts.join(header.select("election_id", cast.alias("cast")), "election_id").withColumn("rate", _ratio(F.col("votes"), F.col("cast"))).drop("cast")
    header = header.join(counts.groupBy("election_id").agg(F.sum("votes").alias("_all")), "election_id", "left")
    header = header.withColumn("avg_approvals_per_ballot", _ratio(F.col("_all"), cast)).drop("_all")
    return Result(with_winner(header, tied_at_top(counts, "votes"), tiebreak), counts)


def score(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None = None, tiebreak: Tiebreak = lexicographic, max_score: int = B.MAX_SCORE, weight: str | None = None) -> Result:
    """Points per candidate; a ballot that does not score a candidate gives it 0."""
    sums = ballots.select(*_kept(weight=weight), F.explode("scores").alias("candidate_id", "v")).groupBy(*KEY).agg(F.sum(F.col("v").cast("long") * of(weight)).alias("votes"))
    header = _header(ballots, candidates, elections, B.is_map_abstention("scores"), weight)
    most = F.lit(max_score) * _cast(weight)
    header = header.withColumn("max_possible_score", most.cast("long") if weight is None else most)
    counts = zero_filled(candidates, sums).join(header.select("election_id", "max_possible_score", _cast(weight).alias("cast")), "election_id")
    counts = counts.withColumn("avg_score", _ratio(F.col("votes"), F.col("cast"))).withColumn("score_pct", _ratio(F.col("votes"), F.col("max_possible_score")) * 100).drop("cast", "max_possible_score")
    return Result(with_winner(header, tied_at_top(counts, "votes"), tiebreak), counts)


def borda(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None = None, tiebreak: Tiebreak = lexicographic, weight: str | None = None) -> Result:
    """(n - 1 - position) points for each place; unknown ids use up a position, beyond n points are negative."""
    places = ballots.select(*_kept(weight=weight), F.posexplode("ranking").alias("pos", "candidate_id"))
    sums = places.groupBy(*KEY).agg(_number(weight).alias("placed"), F.sum(F.col("pos").cast("long") * of(weight)).alias("positions"))
    size = candidates.groupBy("election_id").agg(F.count("*").alias("n"))
    counts = zero_filled(candidates, sums).join(size, "election_id")
    counts = counts.withColumn("votes", F.col("placed") * (F.col("n") - 1) - F.col("positions")).drop("placed", "positions", "n")
    header = _header(ballots, candidates, elections, B.is_list_abstention("ranking"), weight)
    per = counts.groupBy("election_id").agg(F.sum("votes").alias("_all"), F.count("*").alias("_n"))
    header = header.join(per, "election_id", "left").withColumn("max_points_per_ballot", F.greatest(F.coalesce("_n", F.lit(0)) - 1, F.lit(0)).cast("long"))
    header = header.withColumn("avg_points_per_candidate", _ratio(F.col("_all"), F.col("_n"))).drop("_all", "_n")
    return Result(with_winner(header, tied_at_top(counts, "votes"), tiebreak), counts)


def quadratic(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None = None, tiebreak: Tiebreak = lexicographic, weight: str | None = None) -> Result:
    """Net votes per candidate and how credits were used. Without any vote for a candidate nobody wins. Credits are never weighed."""
    cast = ballots.withColumn("credit_budget", F.coalesce("credit_budget", F.lit(B.DEFAULT_CREDIT_BUDGET)))
    votes = cast.select(*_kept("credit_budget", weight=weight), F.explode("allocations").alias("candidate_id", "v")).withColumn("v", F.col("v").cast("long"))
    used = F.when(F.col("credit_budget") == 0, F.lit(0.0)).otherwise((F.col("v") * F.col("v")) / F.col("credit_budget"))
    sums = votes.groupBy(*KEY).agg(F.sum(F.col("v") * of(weight)).alias("votes"), F.sum(F.col("v") * F.col("v")).alias("spent"), F.sum(used).alias("used"), F.count("*").alias("allocated"))
    counts = zero_filled(candidates, sums)
    budget = F.sum(F.when(~B.is_map_abstention("allocations"), F.col("credit_budget").cast("long")).otherwise(F.lit(0)))
    header = _header(cast, candidates, elections, B.is_map_abstention("allocations"), weight, total_credits_available=budget)
    per = counts.groupBy("election_id").agg(F.sum("spent").alias("_spent"), F.sum("used").alias("_used"), F.sum("allocated").alias("_allocated"), F.count_if(F.col("votes") < 0).alias("_negative"))
    header = header.join(per, "election_id", "left").select(
        "election_id", "total_ballots", "abstentions", *(["total_weight", "abstained_weight"] if weight else []), F.coalesce("_spent", F.lit(0)).cast("long").alias("total_credits_spent"), "total_credits_available",
        _ratio(F.col("_spent"), F.col("total_credits_available")).alias("overall_utilization"),
        _ratio(F.col("_used"), F.col("total_ballots") - F.col("abstentions")).alias("avg_voter_utilization"),
        F.coalesce("_negative", F.lit(0)).cast("long").alias("candidates_with_negative_totals"), (F.coalesce("_allocated", F.lit(0)) > 0).alias("_any"),
    )
    won = with_winner(header, tied_at_top(counts, "votes"), tiebreak)
    nobody = F.array().cast("array<string>")
    won = won.withColumn("winners", F.when(F.col("_any"), F.col("winners")).otherwise(nobody)).withColumn("tiebreak_applied", F.col("tiebreak_applied") & F.col("_any")).drop("_any")
    return Result(won, counts.drop("spent", "used", "allocated"))
