"""Instant runoff over weighted profiles.

Elections of few distinct rankings, however many ballots, are folded within a row each, all rounds in one job; those of
many step together, one small state row each, a job and a stored table for each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ballots as B
from ..functions.tiebreak import Tiebreak, lexicographic
from ..sources.scratch import stored
from .condorcet import profiles
from .tally import Result, all_elections

_IDS = "array<string>"
_ROUND = "struct<round_number:int,left:array<string>,n:array<bigint>,active:bigint,done:boolean,winner:string,eliminated:array<string>,all_tied:boolean,tied:boolean>"
#: Elections of at most so many distinct rankings are folded in a row.
FOLDED = 2000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(elections: DataFrame, tiebreak: Tiebreak) -> DataFrame:
    """The rounds of elections (election_id, left, cast, tied, profiles), as the loop of :func:`instant_runoff` gives them."""
    nothing = F.lit(0).cast("long")

    def step(state: Column, number: Column) -> Column:
        left, last = state["left"], state["last"]
        firsts = F.transform("profiles", lambda p: F.struct(F.get(F.filter(p["ranking"], lambda c: F.array_contains(left, c)), F.lit(0)).alias("c"), p["weight"].alias("w")))
        counts = _let(firsts, lambda f: F.transform(left, lambda c: F.aggregate(F.filter(f, lambda x: x["c"] == c), nothing, lambda s, x: s + x["w"])))

        def counted(n: Column) -> Column:
            active = F.aggregate(n, nothing, lambda s, x: s + x)
            return F.struct(n.alias("n"), active.alias("active"), (last | (F.array_max(n) * 2 > active)).alias("done"), F.filter(left, lambda c, i: F.get(n, i) == F.array_min(n)).alias("lowest"))

        def decided(x: Column) -> Column:
            all_tied = ~x["done"] & (F.size(x["lowest"]) == F.size(left))
            most = F.get(F.filter(left, lambda c, i: F.get(x["n"], i) == F.array_max(x["n"])), F.lit(0))
            winner = F.when(last, F.get(left, F.lit(0))).when(x["done"], most).when(all_tied, tiebreak(left, F.col("election_id")))
            return _let(winner, lambda w: F.struct(w.alias("winner"), all_tied.alias("all_tied"), F.when(x["done"], F.array().cast(_IDS)).when(all_tied, F.array_remove(left, w)).otherwise(x["lowest"]).alias("eliminated")))

        def moved(x: Column) -> Column:
            def next_state(d: Column) -> Column:
                told = F.struct(
                    number.alias("round_number"), left.alias("left"), x["n"].alias("n"), x["active"].alias("active"), x["done"].alias("done"), d["winner"].alias("winner"), d["eliminated"].alias("eliminated"),
                    d["all_tied"].alias("all_tied"), state["tied"].alias("tied"),
                )
                rest = F.array_except(left, d["eliminated"])
                return F.struct(rest.alias("left"), (F.size(rest) == 1).alias("last"), (state["tied"] | d["all_tied"]).alias("tied"), x["done"].alias("over"), F.array_append(state["rounds"], told.cast(_ROUND)).alias("rounds"))

            return _let(decided(x), next_state)

        return F.when(state["over"], state).otherwise(_let(_let(counts, counted), moved))

    start = F.struct(F.col("left"), F.lit(False).alias("last"), F.col("tied"), F.lit(False).alias("over"), F.array().cast(f"array<{_ROUND}>").alias("rounds"))
    rounds = F.aggregate(F.sequence(F.lit(1), F.size("left") + 1), start, step)["rounds"]
    return elections.select("election_id", "cast", F.explode(rounds).alias("r")).select("election_id", "r.round_number", "r.left", "r.n", "r.active", "cast", "r.done", "r.winner", "r.eliminated", "r.all_tied", "r.tied")


def unknown_ids(ballots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(election_id, candidate_id) that ballots rank although they are no candidates."""
    ranked = ballots.select("election_id", F.explode("ranking").alias("candidate_id")).distinct()
    return ranked.join(candidates, ["election_id", "candidate_id"], "left_anti")


def instant_runoff(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None = None, tiebreak: Tiebreak = lexicographic, strict: bool = False, weight: str | None = None) -> Result:
    """Instant runoff. header adds total_exhausted and winning_round; counts are the last round's; more: rounds, round_counts.

    A ballot counts for its first choice still in. More than half of a round's active ballots win. Else all at the
    fewest votes go at once; if that is everybody, ``tiebreak`` names the winner and the others go; when one is left
    it is counted once more and wins with any number. Ids that are no candidates are passed over; ``strict`` raises
    an error for them instead. ``weight`` is a column of whole numbers that ballots count; totals stay numbers of ballots.
    """
    if strict and not unknown_ids(ballots, candidates).isEmpty():
        raise KeyError("a ballot ranks an id that is not a candidate")
    ids = candidates.groupBy("election_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "candidate_id"))), lambda x: x["candidate_id"]).alias("left"))
    votes = stored(profiles(ballots, weight), "irv-profiles")
    cast = votes.groupBy("election_id").agg(F.sum("weight").alias("cast"), F.count("*").alias("rankings"))
    state = ids.join(cast, "election_id", "left").select("election_id", "left", F.coalesce("cast", F.lit(0).cast("long")).alias("cast"), F.coalesce("rankings", F.lit(0)).alias("rankings"), F.lit(False).alias("last"), F.lit(False).alias("tied"))
    state = stored(state, "irv-state")
    small = state.filter(F.col("rankings") <= FOLDED)
    lists = votes.join(small.select("election_id"), "election_id", "left_semi").groupBy("election_id").agg(F.collect_list(F.struct("ranking", "weight")).alias("profiles"))
    small = small.join(lists, "election_id", "left").withColumn("profiles", F.coalesce("profiles", F.array().cast("array<struct<ranking:array<string>,weight:bigint>>")))
    rounds = stored(_folded(small, tiebreak), "irv-round")
    state, number = state.filter(F.col("rankings") > FOLDED).drop("rankings"), 0
    while not state.isEmpty():
        number += 1
        active = votes.join(state.select("election_id", "left"), "election_id")
        first = F.get(F.filter("ranking", lambda c: F.array_contains(F.col("left"), c)), F.lit(0))
        sums = active.groupBy("election_id", first.alias("c")).agg(F.sum("weight").alias("v")).filter("c IS NOT NULL")
        lists = sums.groupBy("election_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("got"), F.sum("v").alias("active"))
        at = state.join(lists, "election_id", "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long")))
        none = F.create_map().cast("map<string,bigint>")
        at = at.withColumn("got", F.coalesce("got", none)).withColumn("n", F.transform("left", lambda c: F.coalesce(F.col("got")[c], F.lit(0).cast("long"))))
        at = at.withColumn("fewest", F.array_min("n")).withColumn("most", F.array_max("n"))
        done = F.col("last") | (F.col("most") * 2 > F.col("active"))
        lowest = F.filter("left", lambda c, i: F.get("n", i) == F.col("fewest"))
        at = at.withColumn("done", done).withColumn("lowest", lowest).withColumn("all_tied", ~F.col("done") & (F.size("lowest") == F.size("left")))
        chosen = F.when(F.col("last"), F.get("left", F.lit(0))).when(F.col("done"), F.get(F.filter("left", lambda c, i: F.get("n", i) == F.col("most")), F.lit(0))).when(F.col("all_tied"), tiebreak(F.col("left"), F.col("election_id")))
        at = at.withColumn("winner", chosen)
        out = F.when(F.col("done"), F.array().cast(_IDS)).when(F.col("all_tied"), F.array_remove("left", F.col("winner"))).otherwise(F.col("lowest"))
        at = at.withColumn("eliminated", out).withColumn("round_number", F.lit(number))
        at = stored(at.select("election_id", "round_number", "left", "n", "active", "cast", "done", "winner", "eliminated", "all_tied", "tied"), "irv-round")
        rounds = rounds.unionByName(at)
        left = F.array_except("left", "eliminated")
        following = at.filter(~F.col("done")).select("election_id", left.alias("left"), "cast", (F.size(left) == 1).alias("last"), (F.col("tied") | F.col("all_tied")).alias("tied"))
        state = following  # of the stored round, so that nothing is worked out twice
    totals = ballots.groupBy("election_id").agg(F.count("*").alias("total_ballots"), F.count_if(B.is_list_abstention("ranking")).alias("abstentions"))
    header = all_elections(ballots, candidates, elections).join(totals, "election_id", "left")
    header = header.select("election_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total_ballots", "abstentions")])
    final = rounds.filter("done").select("election_id", F.array("winner").alias("winners"), "tied", (F.col("cast") - F.col("active")).alias("total_exhausted"), F.col("round_number").alias("winning_round"))
    header = header.join(final, "election_id", "left").select(
        "election_id", F.coalesce("winners", F.array().cast(_IDS)).alias("winners"), "total_ballots", "abstentions", F.coalesce("tied", F.lit(False)).alias("tiebreak_applied"),
        F.coalesce("total_exhausted", F.lit(0).cast("long")).alias("total_exhausted"), F.coalesce("winning_round", F.lit(0)).alias("winning_round"),
    )
    counts = rounds.select("election_id", "round_number", "done", F.explode(F.arrays_zip("left", "n")).alias("x")).select("election_id", "round_number", F.col("x.left").alias("candidate_id"), F.col("x.n").alias("votes"), "done")
    told = rounds.select("election_id", "round_number", F.col("active").alias("active_ballots"), (F.col("cast") - F.col("active")).alias("exhausted_ballots"), F.array_sort("eliminated").alias("eliminated"), F.col("all_tied").alias("elimination_was_tiebreak"))
    return Result(header, counts.filter("done").drop("done", "round_number"), {"rounds": told, "round_counts": counts.drop("done")})
