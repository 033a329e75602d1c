"""Small elections of every method with results worked out by hand, all of one method in one frame.

Ballots are written as strings: letters are candidates in order, '-' is an abstention.
"""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tallyforge.functions import ballots as B
from tallyforge.operators import condorcet, irv, tally


def _frames(spark, table, column, kind, value, **extra):
    """(ballots, candidates, elections) of all scenarios {name: (candidates, cast)}."""
    cast = [(name, f"v{i}", value(b)) for name, (_, votes, *_) in table.items() for i, b in enumerate(votes)]
    named = [(name, c, c, i) for name, (ids, *_) in table.items() for i, c in enumerate(ids)]
    ballots = spark.createDataFrame(cast, f"election_id string, voter_id string, {column} {kind}")
    candidates = spark.createDataFrame(named, "election_id string, candidate_id string, name string, ord int")
    return ballots, candidates, spark.createDataFrame([(n,) for n in table], "election_id string")


def _check(result, table):
    heads = {r["election_id"]: r for r in result.header.collect()}
    votes = {n: {} for n in table}
    for r in result.counts.collect():
        votes[r["election_id"]][r["candidate_id"]] = r["votes"]
    assert set(heads) == set(table)
    for name, (_, cast, winners, counts, more) in table.items():
        head = heads[name]
        assert head["winners"] == winners, name
        assert head["total_ballots"] == len(cast), name
        if counts is not None:
            assert votes[name] == counts, name
        for key, value in more.items():
            assert head[key] == (pytest.approx(value) if isinstance(value, float) else value), (name, key)


def test_plurality(spark):
    table = {
        "majority": ("ab", "aab", ["a"], {"a": 2, "b": 1}, {"abstentions": 0, "tiebreak_applied": False}),
        "three": ("abc", "aaabbcc", ["a"], {"a": 3, "b": 2, "c": 2}, {"tiebreak_applied": False}),
        "abstaining": ("ab", "a--b", ["a"], {"a": 1, "b": 1}, {"abstentions": 2, "tiebreak_applied": True}),
        "all abstain": ("ab", "--", ["a"], {"a": 0, "b": 0}, {"abstentions": 2, "tiebreak_applied": True}),
        "tie": ("ab", "ab", ["a"], {"a": 1, "b": 1}, {"tiebreak_applied": True}),
        "no ballots": ("ab", "", ["a"], {"a": 0, "b": 0}, {"tiebreak_applied": True}),
        "no candidates": ("", "a", [], {}, {"abstentions": 0}),
        "unknown": ("ab", "ac", ["a"], {"a": 1, "b": 0}, {"abstentions": 0}),
    }
    ballots, candidates, elections = _frames(spark, table, "choice", "string", lambda b: None if b == "-" else b)
    chosen = ballots.select("election_id", *B.single_choice("voter_id", "choice"))
    _check(tally.plurality(chosen, candidates, elections), table)


def test_approval(spark):
    table = {
        "majority": ("abc", ["ab", "ac", "a", "b"], ["a"], {"a": 3, "b": 2, "c": 1}, {"tiebreak_applied": False}),
        "mean": ("abc", ["ab", "a", "abc"], ["a"], {"a": 3, "b": 2, "c": 1}, {"avg_approvals_per_ballot": 2.0}),
        "abstaining": ("ab", ["ab", "", "a"], ["a"], {"a": 2, "b": 1}, {"avg_approvals_per_ballot": 1.5, "abstentions": 1}),
        "all abstain": ("ab", ["", ""], ["a"], {"a": 0, "b": 0}, {"avg_approvals_per_ballot": 0.0, "tiebreak_applied": True}),
        "unknown": ("ab", ["ax"], ["a"], {"a": 1, "b": 0}, {}),
        "repeated": ("ab", ["aab", "b"], ["b"], {"a": 1, "b": 2}, {}),
    }
    ballots, candidates, elections = _frames(spark, table, "approvals", "array<string>", list)
    made = ballots.select("election_id", *B.approval("voter_id", "approvals"))
    result = tally.approval(made, candidates, elections)
    _check(result, table)
    assert {r["candidate_id"]: r["rate"] for r in result.counts.filter("election_id = 'majority'").collect()} == {"a": 0.75, "b": 0.5, "c": 0.25}
    sizes = made.filter("election_id = 'repeated'").select("voter_id", B.approval_count().alias("n")).collect()
    assert {r["voter_id"]: r["n"] for r in sizes} == {"v0": 2, "v1": 1}


def _map(text):
    return {c[0]: int(c[1:]) for c in text.split()} or None


def test_score(spark):
    table = {
        "sum": ("abc", ["a10 b5 c0", "a8 b6 c4", "a9 b7 c2"], ["a"], {"a": 27, "b": 18, "c": 6}, {"max_possible_score": 30}),
        "partial": ("abc", ["a10", "b8", "a5 b5 c10"], ["a"], {"a": 15, "b": 13, "c": 10}, {}),
        "abstaining": ("ab", ["a10 b5", "a10 b5", ""], ["a"], {"a": 20, "b": 10}, {"max_possible_score": 20, "abstentions": 1}),
        "all abstain": ("ab", ["", ""], ["a"], {"a": 0, "b": 0}, {"max_possible_score": 0, "tiebreak_applied": True}),
        "zeros": ("ab", ["a0 b0", "a0 b0"], ["a"], {"a": 0, "b": 0}, {"abstentions": 0, "tiebreak_applied": True}),
        "unknown": ("ab", ["a10 b5 x8"], ["a"], {"a": 10, "b": 5}, {}),
    }
    ballots, candidates, elections = _frames(spark, table, "scores", "map<string,int>", _map)
    result = tally.score(ballots.select("election_id", *B.score("voter_id", "scores")), candidates, elections)
    _check(result, table)
    told = {r["candidate_id"]: (r["avg_score"], r["score_pct"]) for r in result.counts.filter("election_id = 'abstaining'").collect()}
    assert told == {"a": (10.0, 100.0), "b": (5.0, 50.0)}


def test_borda(spark):
    table = {
        "one": ("abcd", ["abcd"], ["a"], {"a": 3, "b": 2, "c": 1, "d": 0}, {"max_points_per_ballot": 3}),
        "three": ("abc", ["abc", "abc", "bac"], ["a"], {"a": 5, "b": 4, "c": 0}, {}),
        "reverse": ("abc", ["abc", "abc", "cba", "cba", "cba"], ["c"], {"a": 4, "b": 5, "c": 6}, {}),
        "cycle": ("abc", ["abc", "bca", "cab"], ["a"], {"a": 3, "b": 3, "c": 3}, {"tiebreak_applied": True}),
        "abstaining": ("abc", ["abc", "abc", ""], ["a"], {"a": 4, "b": 2, "c": 0}, {"abstentions": 1}),
        "mean": ("abc", ["abc", "bca"], ["b"], {"a": 2, "b": 3, "c": 1}, {"avg_points_per_candidate": 2.0}),
        "alone": ("a", ["a", "a"], ["a"], {"a": 0}, {"max_points_per_ballot": 0}),
        "no ballots": ("ab", [], ["a"], {"a": 0, "b": 0}, {"tiebreak_applied": True}),
        "no candidates": ("", [], [], {}, {"avg_points_per_candidate": 0.0}),
        "unknown last": ("ab", ["abx"], ["a"], {"a": 1, "b": 0}, {}),
        "unknown first": ("ab", ["xab"], ["a"], {"a": 0, "b": -1}, {}),
    }
    ballots, candidates, elections = _frames(spark, table, "ranking", "array<string>", list)
    _check(tally.borda(ballots.select("election_id", *B.ranked("voter_id", "ranking")), candidates, elections), table)


def test_quadratic(spark):
    table = {
        "sum": ("abc", ["a5 b2", "a3 c4", "a2 b1"], ["a"], {"a": 10, "b": 3, "c": 4}, {"total_credits_spent": 59}),
        "against": ("ab", ["a5", "a-3", "b4"], ["b"], {"a": 2, "b": 4}, {}),
        "all against": ("ab", ["a-3 b-5", "a-2 b-4"], ["a"], {"a": -5, "b": -9}, {"candidates_with_negative_totals": 2}),
        "mixed": ("abc", ["a7 b-5", "b6 c-3", "c8 a-4"], ["c"], {"a": 3, "b": 1, "c": 5}, {}),
        "spent": ("ab", ["a5", "b3"], ["a"], None, {"total_credits_spent": 34, "total_credits_available": 200}),
        "utilization": ("ab", ["a10", "a5"], ["a"], None, {"avg_voter_utilization": 0.625}),
        "negative": ("abc", ["a5 b-3 c-2"], ["a"], None, {"candidates_with_negative_totals": 2}),
        "all abstain": ("ab", ["", ""], [], {"a": 0, "b": 0}, {"tiebreak_applied": False, "total_credits_spent": 0, "total_credits_available": 0, "abstentions": 2}),
        "abstaining": ("ab", ["a7", "", "b4", ""], ["a"], None, {"total_credits_spent": 65, "total_credits_available": 200, "abstentions": 2}),
        "unknown too": ("ab", ["a5 x7"], ["a"], None, {"total_credits_spent": 25, "total_credits_available": 100, "overall_utilization": 0.25, "avg_voter_utilization": 0.25}),
        "unknown only": ("ab", ["x5", "y-3"], [], {"a": 0, "b": 0}, {"tiebreak_applied": False}),
    }
    ballots, candidates, elections = _frames(spark, table, "allocations", "map<string,int>", _map)
    _check(tally.quadratic(ballots.select("election_id", *B.quadratic("voter_id", "allocations")), candidates, elections), table)
    budgets = {"two": ("ab", ["a2", "a1"], ["a"], None, {"total_credits_available": 150}), "more": ("ab", ["a5", "b3"], ["a"], None, {"total_credits_available": 150, "total_credits_spent": 34})}
    ballots, candidates, elections = _frames(spark, budgets, "allocations", "map<string,int>", _map)
    ballots = ballots.select("election_id", *B.quadratic("voter_id", "allocations", F.when(F.col("voter_id") == "v0", 100).otherwise(50)))
    _check(tally.quadratic(ballots, candidates, elections), budgets)


@pytest.mark.parametrize("folded", [2000, 2, -1])
def test_instant_runoff(spark, monkeypatch, folded):
    monkeypatch.setattr(irv, "FOLDED", folded)
    table = {
        "first round": ("abc", ["abc", "acb", "abc", "bac"], ["a"], {"a": 3, "b": 1, "c": 0}, {"winning_round": 1}),
        "two rounds": ("abc", ["abc", "acb", "bac", "bca", "cba"], ["b"], {"a": 2, "b": 3}, {"winning_round": 2, "tiebreak_applied": False}),
        "tie at the end": ("abcd", ["acbd", "adcb", "bcad", "bdac", "cabd", "dbca"], ["a"], None, {"tiebreak_applied": True}),
        "many at once": ("abcd", ["abcd", "acbd", "adbc", "bacd", "cabd", "dabc"], ["a"], {"a": 6}, {"winning_round": 2, "tiebreak_applied": False}),
        "tie": ("ab", ["ab", "ba"], ["a"], None, {"tiebreak_applied": True}),
        "abstaining": ("abc", ["abc", "abc", "bac", "", ""], ["a"], None, {"abstentions": 2}),
        "all abstain": ("ab", ["", ""], ["a"], None, {"abstentions": 2, "tiebreak_applied": True}),
        "alone": ("a", ["a", "a"], ["a"], {"a": 2}, {"winning_round": 1}),
        "alone, abstaining": ("a", [""], ["a"], None, {"tiebreak_applied": True, "winning_round": 2}),
        "no ballots": ("ab", [], ["a"], None, {"tiebreak_applied": True}),
        "no candidates": ("", [], [], {}, {}),
        "exhausted": ("abc", ["a", "a", "b", "bc", "c"], ["a"], {"a": 2}, {"total_exhausted": 3, "winning_round": 3, "tiebreak_applied": True}),
    }
    ballots, candidates, elections = _frames(spark, table, "ranking", "array<string>", list)
    result = irv.instant_runoff(ballots, candidates, elections)
    _check(result, table)
    rounds = {(r["election_id"], r["round_number"]): r for r in result.more["rounds"].collect()}
    counts = {}
    for r in result.more["round_counts"].collect():
        counts.setdefault((r["election_id"], r["round_number"]), {})[r["candidate_id"]] = r["votes"]
    assert counts["two rounds", 1] == {"a": 2, "b": 2, "c": 1} and rounds["two rounds", 1]["eliminated"] == ["c"] and not rounds["two rounds", 1]["elimination_was_tiebreak"]
    assert rounds["tie at the end", 1]["eliminated"] == ["c", "d"] and counts["tie at the end", 2] == {"a": 3, "b": 3}
    assert rounds["many at once", 1]["eliminated"] == ["b", "c", "d"]
    assert (rounds["exhausted", 2]["active_ballots"], rounds["exhausted", 2]["exhausted_ballots"]) == (4, 1)
    with pytest.raises(KeyError):
        irv.instant_runoff(ballots.withColumn("ranking", F.array(F.lit("x"))), candidates, strict=True)


def test_ranked_pairs(spark):
    table = {
        "winner": ("abc", ["abc", "abc", "acb", "bac"], ["a"], None, {"had_condorcet_winner": True, "tiebreak_applied": False}),
        "majority": ("abc", ["bac", "bac", "cab", "cab", "abc"], ["a"], None, {"had_condorcet_winner": True}),
        "cycle": ("abc", ["abc", "bca", "cab"], ["a"], None, {"had_condorcet_winner": False}),
        "weak edge": ("abc", ["abc"] * 3 + ["bca"] * 2 + ["cab"] * 2, ["a"], None, {"had_condorcet_winner": False, "tiebreak_applied": True}),
        "other edge": ("abc", ["abc"] * 2 + ["bca"] * 2 + ["cab"] * 3, ["c"], None, {"had_condorcet_winner": False}),
        "tie": ("ab", ["ab", "ba"], ["a"], None, {"tiebreak_applied": False, "tiebreak_function_used": True}),
        "abstaining": ("ab", ["ab", "ab", ""], ["a"], None, {"abstentions": 1}),
        "no first choices": ("abc", ["bac"] * 4 + ["cab"] * 3 + ["acb"] * 2, ["a"], {"a": 2, "b": 0, "c": 1}, {}),
    }
    ballots, candidates, elections = _frames(spark, table, "ranking", "array<string>", list)
    result = condorcet.ranked_pairs(ballots, candidates, elections)
    _check(result, table)
    edges = {(r["election_id"], r["winner"], r["loser"]): (r["margin"], r["status"]) for r in result.more["edges"].collect()}
    assert {k[1:]: v for k, v in edges.items() if k[0] == "weak edge"} == {("a", "b"): (3, "locked"), ("b", "c"): (3, "locked"), ("c", "a"): (1, "skipped")}
    assert {k[1:]: v for k, v in edges.items() if k[0] == "other edge"} == {("a", "b"): (3, "locked"), ("c", "a"): (3, "locked"), ("b", "c"): (1, "skipped")}
    assert not any(k[0] == "winner" for k in edges)
    given = condorcet.pairwise_matrix(ballots, candidates).withColumn("votes", F.when((F.col("a") == "b") & (F.col("b") == "a"), F.lit(9)).when((F.col("a") == "a") & (F.col("b") == "b"), F.lit(0)).otherwise(F.col("votes")))
    told = condorcet.ranked_pairs(ballots, candidates, elections, matrix=given, include_matrix=False)
    assert "matrix" not in told.more
    assert {r["election_id"]: r["winners"] for r in told.header.collect()}["tie"] == ["b"]


def test_ballots_that_break_rules(spark):
    def failing(frame, error):
        with pytest.raises(PySparkException, match="invalid ballot"):
            B.checked(frame, error).collect()
        return [r["error"] for r in B.checked(frame, error, strict=False).orderBy("voter_id").collect()]

    ranked = spark.createDataFrame([("v0", list("ab")), ("v1", list("aa")), ("v2", list("ax")), ("v3", ["a"]), ("v4", list("abx"))], "voter_id string, ranking array<string>")
    assert failing(ranked, B.ranked_error("ranking", F.array(F.lit("a"), F.lit("b")))) == [None, "duplicates", "missing_and_unknown", "incomplete", "unknown"]
    scores = spark.createDataFrame([("v0", {"a": 10}), ("v1", {"a": -1}), ("v2", {"a": 11}), ("v3", {"a": None})], "voter_id string, scores map<string,int>")
    assert failing(scores, B.score_error("scores")) == [None, "out_of_range", "out_of_range", "out_of_range"]
    spent = spark.createDataFrame([("v0", {"a": 10}), ("v1", {"a": 8, "b": 7}), ("v2", {"a": 0}), ("v3", {"a": None}), ("v4", {"a": -1})], "voter_id string, allocations map<string,int>")
    spent = spent.select(*B.quadratic("voter_id", "allocations"))
    assert failing(spent, B.quadratic_error("allocations", "credit_budget", allow_negative=False)) == [None, "over_budget", "zero", "not_integer", "negative"]
    assert B.checked(spent.filter("voter_id = 'v0'"), B.quadratic_error("allocations", "credit_budget")).count() == 1


def test_measures_of_quadratic_ballots(spark):
    row = spark.sql("SELECT map('a', 3, 'b', -5) AS m, 100 AS b").select(
        *[B.cost_of_votes(F.lit(v)).alias(f"c{v}") for v in (1, 3, 10)], B.credits_remaining("m", "b").alias("left"), B.votes_for("m", F.lit("b")).alias("b"), B.votes_for("m", F.lit("x")).alias("x"),
        *[B.max_votes_for_budget(F.lit(v)).alias(f"m{v}") for v in (100, 50, 1, 0)],
    ).first()
    assert tuple(row) == (1, 9, 100, 66, -5, 0, 10, 7, 1, 0)
