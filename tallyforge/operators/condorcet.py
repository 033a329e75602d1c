"""Ranked ballots as weighted profiles, pairwise matrices, Condorcet winners and ranked pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ballots as B
from ..functions.tiebreak import Tiebreak, lexicographic
from .tally import Result, all_elections, of


def profiles(ballots: DataFrame, weight: str | None = None) -> DataFrame:
    """Distinct rankings with what the ballots that state them count: (election_id, ranking, weight), without abstentions.

    ``weight`` is a column of whole numbers; without it every ballot counts 1.
    """
    return ballots.filter(~B.is_list_abstention("ranking")).groupBy("election_id", "ranking").agg(F.sum(of(weight)).cast("long").alias("weight"))


def _pairs_of(ranking: str) -> Column:
    """Every (a, b) with a ranked above b, made inside the row."""
    r = F.col(ranking)
    return F.flatten(F.transform(r, lambda a, i: F.transform(F.slice(r, i + 2, F.size(r)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pairwise_matrix(ballots: DataFrame, candidates: DataFrame, weight: str | None = None) -> DataFrame:
    """(election_id, a, b, votes): ballots that rank a above b, for each ordered pair of candidates; a ballot that leaves one unranked counts for neither."""
    votes = profiles(ballots, weight).select("election_id", "weight", F.explode(_pairs_of("ranking")).alias("p"))
    return _all_pairs(candidates, votes.groupBy("election_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("weight").alias("votes")))


def _all_pairs(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """``votes`` (election_id, a, b, votes) of every ordered pair of candidates, 0 where there is no row."""
    left = candidates.select("election_id", F.col("candidate_id").alias("a"))
    right = candidates.select("election_id", F.col("candidate_id").alias("b"))
    pairs = left.join(right, "election_id").filter("a <> b")
    return pairs.join(votes, ["election_id", "a", "b"], "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))


def margins(matrix: DataFrame) -> DataFrame:
    """The matrix with margin = votes for a over b less those for b over a."""
    back = matrix.select("election_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("votes").alias("against"))
    return matrix.join(back, ["election_id", "a", "b"]).withColumn("margin", F.col("votes") - F.col("against"))


def wins(margin: DataFrame, candidates: DataFrame) -> DataFrame:
    """(election_id, candidate_id, ord, votes, n): each candidate's head-to-head wins and its election's size."""
    won = margin.groupBy("election_id", F.col("a").alias("candidate_id")).agg(F.count_if(F.col("margin") > 0).alias("votes"))
    size = candidates.groupBy("election_id").agg(F.count("*").alias("n"))
    joined = candidates.select("election_id", "candidate_id", "ord").join(size, "election_id").join(won, ["election_id", "candidate_id"], "left")
    return joined.withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))


def condorcet_winner(won: DataFrame) -> DataFrame:
    """(election_id, candidate_id) of the candidates that beat all others."""
    return won.filter(F.col("votes") == F.col("n") - 1).select("election_id", "candidate_id")


def victories(margin: DataFrame) -> DataFrame:
    """One edge per pair with a margin, strongest first: (election_id, seq, winner, loser, margin, winning_votes).

    By margin, then winning votes; remaining ties by the winner's and the loser's id, so that reruns agree.
    """
    order = Window.partitionBy("election_id").orderBy(F.desc("margin"), F.desc("votes"), "a", "b")
    edges = margin.filter("margin > 0").withColumn("seq", F.row_number().over(order))
    return edges.select("election_id", "seq", F.col("a").alias("winner"), F.col("b").alias("loser"), "margin", F.col("votes").alias("winning_votes"))


def _lock(edges: Column, n: Column) -> Column:
    """The places in ``edges`` (w and l: the numbers, from 0, of n candidates) that are skipped as they would close a cycle.

    Whom a candidate reaches over locked edges is a row of bits, 64 to a whole number. An edge whose winner reaches its
    loser already changes no row, so that rows are gone through for few of the edges.
    """
    words = F.ceil(n / 64).cast("int")

    def bit(reach: Column, a: Column, b: Column) -> Column:
        return F.call_function("shiftright", F.get(reach, a * words + F.call_function("shiftright", b, F.lit(6))), b.bitwiseAND(63)).bitwiseAND(1) == 1

    def step(state: Column, e: Column) -> Column:
        reach, w, lo = state["reach"], e["w"], e["l"]

        def joined(v: Column, i: Column) -> Column:
            x, k = (i / words).cast("int"), i % words
            own = F.when(k == F.call_function("shiftright", lo, F.lit(6)), F.call_function("shiftleft", F.lit(1).cast("long"), lo.bitwiseAND(63))).otherwise(F.lit(0).cast("long"))
            return F.when((x == w) | bit(reach, x, w), v.bitwiseOR(F.get(reach, lo * words + k)).bitwiseOR(own)).otherwise(v)

        cycle = bit(reach, lo, w)
        return F.struct(
            F.when(cycle | bit(reach, w, lo), reach).otherwise(F.transform(reach, joined)).alias("reach"),
            F.when(cycle, F.array_append(state["skipped"], state["at"])).otherwise(state["skipped"]).alias("skipped"), (state["at"] + 1).alias("at"),
        )

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), (n * words).cast("int")).alias("reach"), F.array().cast("array<int>").alias("skipped"), F.lit(0).alias("at"))
    return F.aggregate(edges, start, step)["skipped"]


def ranked_pairs(ballots: DataFrame, candidates: DataFrame, elections: DataFrame | None = None, tiebreak: Tiebreak = lexicographic, matrix: DataFrame | None = None, include_matrix: bool = True, weight: str | None = None) -> Result:
    """Ranked pairs. header adds had_condorcet_winner and tiebreak_function_used; more: edges and matrix.

    Where a candidate beats all others it wins and no edge is locked; with one candidate alone its count is the ballots
    cast. Else edges are locked strongest first and a candidate that no locked edge beats wins; ``tiebreak`` chooses
    among several. ``tiebreak_applied`` says that an edge was skipped, not that ``tiebreak`` ran. A ``matrix`` from the
    caller replaces counting; pairs of candidates it has no row for count 0, and ballots give the totals only. Without ``include_matrix`` more holds the edges alone.
    """
    matrix = pairwise_matrix(ballots, candidates, weight) if matrix is None else _all_pairs(candidates, matrix)
    margin = margins(matrix)
    won = wins(margin, candidates)
    best = condorcet_winner(won)
    totals = ballots.groupBy("election_id").agg(F.count("*").alias("total_ballots"), F.count_if(B.is_list_abstention("ranking")).alias("abstentions"))
    header = all_elections(ballots, candidates, elections).join(totals, "election_id", "left")
    header = header.select("election_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total_ballots", "abstentions")])
    open_ = won.groupBy("election_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "candidate_id"))), lambda x: x["candidate_id"]).alias("ids"))
    open_ = open_.join(best, "election_id", "left_anti")
    number = F.row_number().over(Window.partitionBy("election_id").orderBy("ord", "candidate_id")) - 1
    numbers = candidates.select("election_id", "candidate_id", number.alias("at"))
    numbered = victories(margin).join(numbers.select("election_id", F.col("candidate_id").alias("winner"), F.col("at").alias("w")), ["election_id", "winner"]).join(numbers.select("election_id", F.col("candidate_id").alias("loser"), F.col("at").alias("l")), ["election_id", "loser"])
    ordered = numbered.groupBy("election_id").agg(F.array_sort(F.collect_list(F.struct("seq", "w", "l", "winner", "loser", "margin", "winning_votes"))).alias("edges"))
    none = F.array().cast("array<struct<seq:int,w:int,l:int,winner:string,loser:string,margin:bigint,winning_votes:bigint>>")
    folded = open_.join(ordered, "election_id", "left").withColumn("edges", F.coalesce("edges", none))
    folded = folded.withColumn("skips", _lock(F.col("edges"), F.size("ids")))
    places = F.when(F.size("edges") > 0, F.sequence(F.lit(0), F.size("edges") - 1)).otherwise(F.array().cast("array<int>"))
    taken = lambda at: F.transform(at, lambda i: F.get("edges", i))
    folded = folded.select("election_id", "ids", taken(F.array_except(places, "skips")).alias("locked"), taken(F.col("skips")).alias("skipped"))
    folded = folded.withColumn("sources", F.array_except("ids", F.transform("locked", lambda e: e["loser"])))
    joined = header.join(best.withColumnRenamed("candidate_id", "_best"), "election_id", "left").join(folded, "election_id", "left")
    nobody = F.array().cast("array<string>")
    several = F.coalesce(F.size("sources") > 1, F.lit(False))
    winners = F.when(F.col("_best").isNotNull(), F.array("_best")).when(several, F.array(tiebreak(F.col("sources"), F.col("election_id")))).otherwise(F.coalesce("sources", nobody))
    result = joined.select(
        "election_id", winners.alias("winners"), "total_ballots", "abstentions", F.coalesce(F.size("skipped") > 0, F.lit(False)).alias("tiebreak_applied"),
        F.col("_best").isNotNull().alias("had_condorcet_winner"), several.alias("tiebreak_function_used"),
    )
    cast = ballots.groupBy("election_id").agg(F.sum(F.when(B.is_list_abstention("ranking"), F.lit(0)).otherwise(of(weight))).cast("long").alias("_cast"))
    counts = won.join(cast, "election_id", "left").withColumn("_cast", F.coalesce("_cast", F.lit(0).cast("long")))
    counts = counts.select("election_id", "candidate_id", "ord", F.when(F.col("n") == 1, F.col("_cast")).otherwise(F.col("votes")).alias("votes"))
    edges = folded.select("election_id", F.explode(F.concat(F.transform("locked", lambda e: F.struct(e.alias("e"), F.lit("locked").alias("status"))), F.transform("skipped", lambda e: F.struct(e.alias("e"), F.lit("skipped").alias("status"))))).alias("x"))
    order = Window.partitionBy("election_id").orderBy(F.desc("margin"), F.desc("winning_votes"), "winner", "loser")
    edges = edges.select("election_id", *[f"x.e.{c}" for c in ("winner", "loser", "margin", "winning_votes")], "x.status").withColumn("seq", F.row_number().over(order))
    return Result(result, counts, {"edges": edges} | ({"matrix": matrix} if include_matrix else {}))
