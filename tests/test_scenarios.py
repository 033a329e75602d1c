"""Hand-made elections with results worked out by hand, and properties of random ones."""

import random

import pytest
from pyspark.sql import functions as F
from tallyforge.functions import ballots as B
from tallyforge.functions.tiebreak import candidate_order, seeded
from tallyforge.operators import condorcet, irv, tally
from tallyforge.streaming import tallies


def candidates(spark, ids, election="e"):
    return spark.createDataFrame([(election, c, c.title(), i) for i, c in enumerate(ids)], "election_id string, candidate_id string, name string, ord int")


def ballots(spark, values, kind, name, election="e"):
    return spark.createDataFrame([(election, f"v{i}", v) for i, v in enumerate(values)], f"election_id string, voter_id string, {name} {kind}")


def votes(result):
    return {r["candidate_id"]: r["votes"] for r in result.counts.collect()}


@pytest.mark.parametrize(
    ("cast", "ids", "winners", "counts", "abstentions", "tie"),
    [
        (["a", "a", "b"], "ab", ["a"], {"a": 2, "b": 1}, 0, False),
        (["a", None, None, "b"], "ab", ["a"], {"a": 1, "b": 1}, 2, True),
        ([None, None], "ab", ["a"], {"a": 0, "b": 0}, 2, True),
        (["a", "x"], "ab", ["a"], {"a": 1, "b": 0}, 0, False),
        (["a"], "", [], {}, 0, False),
    ],
)
def test_plurality(spark, cast, ids, winners, counts, abstentions, tie):
    result = tally.plurality(ballots(spark, cast, "string", "choice"), candidates(spark, ids))
    head = result.header.first()
    assert (head["winners"], votes(result), head["total_ballots"], head["abstentions"], head["tiebreak_applied"]) == (winners, counts, len(cast), abstentions, tie)


def test_an_election_without_ballots_has_a_result(spark):
    empty = ballots(spark, ["a"], "string", "choice").limit(0)
    assert tally.plurality(empty, candidates(spark, "ba"), tiebreak=candidate_order).header.first()["winners"] == ["b"]
    assert irv.instant_runoff(ballots(spark, [["a"]], "array<string>", "ranking").limit(0), candidates(spark, "ab")).header.first()["tiebreak_applied"]


def test_approval_rates(spark):
    result = tally.approval(ballots(spark, [["a"], ["a", "b"], None, []], "array<string>", "approvals"), candidates(spark, "ab"))
    head = result.header.first()
    assert head["avg_approvals_per_ballot"] == 1.5 and head["abstentions"] == 2 and votes(result) == {"a": 2, "b": 1}


def test_quadratic_without_allocations_has_no_winner(spark):
    cast = ballots(spark, [{}, {"x": 3}], "map<string,int>", "allocations").withColumn("credit_budget", F.lit(100))
    head = tally.quadratic(cast, candidates(spark, "ab")).header.first()
    assert head["winners"] == [] and not head["tiebreak_applied"]


def test_instant_runoff_eliminates_all_at_the_fewest(spark):
    cast = [["a", "b"]] * 4 + [["b", "a"]] * 3 + [["c", "b"]] * 1 + [["d", "b"]] * 1
    result = irv.instant_runoff(ballots(spark, cast, "array<string>", "ranking"), candidates(spark, "abcd"))
    rounds = {r["round_number"]: r for r in result.more["rounds"].collect()}
    assert rounds[1]["eliminated"] == ["c", "d"] and result.header.first()["winners"] == ["b"] and result.header.first()["winning_round"] == 2


def test_ranked_pairs_skips_the_weakest_edge_of_a_cycle(spark):
    cast = [["a", "b", "c"]] * 4 + [["b", "c", "a"]] * 3 + [["c", "a", "b"]] * 2
    result = condorcet.ranked_pairs(ballots(spark, cast, "array<string>", "ranking"), candidates(spark, "abc"))
    edges = {(r["winner"], r["loser"]): r["status"] for r in result.more["edges"].collect()}
    assert edges == {("a", "b"): "locked", ("b", "c"): "locked", ("c", "a"): "skipped"}
    head = result.header.first()
    assert head["winners"] == ["a"] and head["tiebreak_applied"] and not head["tiebreak_function_used"]
    tie = condorcet.ranked_pairs(ballots(spark, [["a", "b"], ["b", "a"]], "array<string>", "ranking"), candidates(spark, "ab")).header.first()
    assert tie["tiebreak_function_used"] and not tie["tiebreak_applied"]


def test_properties_of_random_rankings(spark):
    rng = random.Random(4)
    ids = "abcde"
    cast = [rng.sample(ids, 5) for _ in range(60)]
    frame, named = ballots(spark, cast, "array<string>", "ranking"), candidates(spark, ids)
    matrix = {(r["a"], r["b"]): r["votes"] for r in condorcet.pairwise_matrix(frame, named).collect()}
    assert all(matrix[a, b] + matrix[b, a] == 60 and matrix[a, b] == sum(x.index(a) < x.index(b) for x in cast) for a in ids for b in ids if a != b)
    borda = tally.borda(frame, named).counts.collect()
    assert sum(r["votes"] if "votes" in r else r["points"] for r in borda) == 60 * 10
    runoff = irv.instant_runoff(frame, named)
    assert all(r["active_ballots"] + r["exhausted_ballots"] == 60 for r in runoff.more["rounds"].collect())


def test_ballot_functions(spark):
    row = spark.sql("SELECT array('a','b','c') AS r, map('a', 3, 'b', -2) AS m, 9007199515875288L AS big").select(
        B.rank_of("r", F.lit("b")).alias("rank"), B.rank_of("r", F.lit("x")).alias("none"), B.choice_at("r", 0).alias("zero"), B.choice_at("r", 3).alias("third"),
        B.prefers("r", F.lit("a"), F.lit("c")).alias("yes"), B.prefers("r", F.lit("a"), F.lit("x")).alias("unknown"), B.total_cost("m").alias("cost"), B.max_votes_for_budget("big").alias("root"),
    ).first()
    assert tuple(row) == (2, None, None, "c", True, None, 13, 94906266)


def test_seeded_tiebreak_is_stable_and_stays_among_the_tied(spark):
    frame, named = ballots(spark, ["a", "b"], "string", "choice"), candidates(spark, "abc")
    chosen = [tally.plurality(frame, named, tiebreak=seeded(s)).header.first()["winners"][0] for s in (1, 1, 2, 3, 4, 5)]
    assert chosen[0] == chosen[1] and set(chosen) <= {"a", "b"}


def test_streaming_tallies_equal_batch(spark, tmp_path):
    rows = spark.sql("SELECT 'e' AS election_id, if(id % 3 = 0, 'a', 'b') AS choice, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id,0,0) AS ts FROM range(100)")
    rows.write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, tallies.windowed_choices(rows).collect()))
    stream = tallies.windowed_choices(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("tallied").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tallied").collect())) == want
