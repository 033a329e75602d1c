"""Lists, life cycles, private tallies, menus, weights and medians on hand-made cases and against plain loops."""

import math
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyforge.functions import ballots as B
from tallyforge.operators import condorcet, frontier, jurisdiction, lifecycle, listing, median, privacy, tally
from tallyforge.operators.irv import instant_runoff

DAY = datetime(2020, 1, 1)


def day(n):
    return None if n is None else DAY + timedelta(days=n)


def test_facets_count_a_proposal_once_for_every_filter(spark):
    proposals = spark.createDataFrame([(i, "draft" if i % 2 else "passed", day(i)) for i in range(6)], "id long, status string, created_at timestamp")
    topics = spark.createDataFrame([(0, 1, 10), (0, 1, 11), (0, 2, None), (1, 1, 10), (1, 1, 10), (2, 2, None), (9, 1, 10)], "proposal_id long, domain_id int, program_id int")
    rows = listing.listed(proposals, topics)
    got = {tuple(r)[:4]: r["n"] for r in listing.facets(rows).collect()}
    told = [tuple(r) for r in rows.select("domain_id", "program_id", "status", "id").collect()]
    want = defaultdict(set)
    for *values, i in told:
        for level in range(8):
            want[(*[None if level >> (2 - k) & 1 else v for k, v in enumerate(values)], level)].add(i)
    assert got == {k: len(v) for k, v in want.items()} and got[None, None, None, 7] == 6


def test_pages_follow_one_another_without_gaps(spark):
    proposals = spark.createDataFrame([(i, "s", day(i // 3) if i < 20 else None) for i in range(23)], "id long, status string, created_at timestamp")
    topics = spark.createDataFrame([(i, 1 + i % 2, None) for i in range(23) for _ in range(2)], "proposal_id long, domain_id int, program_id int")
    rows, after, seen = listing.listed(proposals, topics), None, []
    while found := listing.page(rows, 4, after, domain_id=1).collect():
        seen += [r["id"] for r in found]
        after = (found[-1]["created_at"], found[-1]["id"])
    assert seen == [*range(18, -1, -2), 22, 20]


def test_verifiability_by_parts(spark):
    metric = "struct<name:string,unit:string,baseline_val:string,baseline_year:int,baseline_source:string,target_val:string,deadline:string>"
    full, half = ("n", "u", "1", 2020, "s", "2", "2030-01-01"), ("n", " ", "1", 2020, "s", "2", "2030-01-01")
    rows = [([full, half], "x", [(1, 0)], 83), ([full], " ", [(-1, 0)], 33), (None, None, None, 0), ([], "x", [], 33), ([full], "x", [(None, 0), (5, 5)], 100)]
    made = spark.createDataFrame(rows, f"metrics array<{metric}>, scope string, items array<struct<one_time_usd:int,annual_usd:int>>, want int")
    assert all(r["s"] == r["want"] for r in made.select("want", listing.verifiability(F.col("metrics"), F.col("scope"), F.col("items")).alias("s")).collect())


HISTORY = [("a", 5, "voting"), ("a", 1, "draft"), ("a", 1, "submitted"), ("a", 5, "voting"), ("a", 7, "voting"), ("a", 9, "passed"), ("b", 3, "enacted"), ("a", None, "passed"), (None, 1, "draft"), ("b", 2, "lost"), ("b", 8, "repealed"), ("b", 1, "submitted")]


def _history(spark, rows):
    return spark.createDataFrame([(p, day(n), s) for p, n, s in rows], "proposal string, at timestamp, status string").repartition(5)


def test_intervals_drop_repeats_and_late_rows_fall_into_place(spark):
    got = {(r["proposal"], r["status"], r["since"], r["until"]) for r in lifecycle.intervals(_history(spark, HISTORY)).collect()}
    want = [("a", "submitted", 1, 5), ("a", "voting", 5, 9), ("a", "passed", 9, None), ("b", "submitted", 1, 3), ("b", "enacted", 3, 8), ("b", "repealed", 8, None)]
    assert got == {(p, s, day(a), day(b)) for p, s, a, b in want}
    assert lifecycle.intervals(_history(spark, [])).count() == 0


def test_votes_take_the_status_of_their_time(spark):
    votes = [("a", 1, 0), ("a", 1, 1), ("a", 2, 5), ("a", 2, 8), ("a", 3, 9), ("c", 1, 4), (None, 1, 1), ("b", 4, None)] + [("a", i, 6) for i in range(500)]
    frame = spark.createDataFrame([(p, v, day(n)) for p, v, n in votes], "proposal string, voter long, at timestamp").repartition(7)
    got = Counter((r["proposal"], r["voter"], r["at"], r["status"]) for r in lifecycle.at_the_time(frame, _history(spark, HISTORY)).collect())
    status = {0: None, 1: "submitted", 5: "voting", 6: "voting", 8: "voting", 9: "passed"}
    assert got == Counter((p, v, day(n), status[n] if p == "a" else None) for p, v, n in votes)
    told = {(r["proposal"], r["status"]): (r["votes"], r["voters"]) for r in lifecycle.turnout(frame, _history(spark, HISTORY)).collect()}
    assert told["a", "voting"] == (502, 500)


def test_rates_count_steps_in_order(spark):
    rows = [("a", 0, "submitted"), ("a", 4, "passed"), ("a", 10, "enacted"), ("a", 30, "repealed"), ("b", 5, "submitted"), ("b", 2, "passed"), ("c", 1, "submitted"), ("c", 21, "enacted"), ("c", 20, "repealed"), ("d", 1, "passed")]
    (got,) = lifecycle.rates(_history(spark, rows)).collect()
    assert tuple(got) == (2020, 3, 1, 2, 1, pytest.approx(1 / 3), 15.0, 0.5)


def test_contributions_are_bounded_under_any_partitioning(spark):
    rows = [(f"e{i % 9}", f"v{i % 13}", f"c{i % 4}") for i in range(2000)] + [(f"e{i}", "hot", "c1") for i in range(3000)] + [(None, "x", "y"), ("e1", None, "y"), ("e1", "x", None)]
    frame = spark.createDataFrame(rows, "election_id string, voter_id string, choice string")
    kept = [sorted(map(tuple, privacy.bounded(frame.repartition(n), 3).collect())) for n in (1, 6)]
    assert kept[0] == kept[1] and set(kept[0]) <= set(rows)
    assert set(Counter(v for _, v, _ in kept[0]).values()) == {3} and len({(e, v) for e, v, _ in kept[0]}) == len(kept[0])


def test_noise_is_two_sided_geometric_and_repeatable(spark):
    scale, n = 2.0, 60_000
    draw = spark.range(n).select(privacy.geometric_noise(scale, F.lit("seed"), F.col("id")).alias("k"))
    found = [r["k"] for r in draw.collect()]
    assert found == [r["k"] for r in draw.collect()]
    a = math.exp(-1 / scale)
    counts = Counter(found)
    for k in range(-4, 5):
        p = (1 - a) / (1 + a) * a ** abs(k)
        assert abs(counts[k] / n - p) < 5 * math.sqrt(p / n)
    assert abs(np.mean(found)) < 0.1 and np.var(found) == pytest.approx(2 * a / (1 - a) ** 2, rel=0.05)


def test_private_tallies_hide_small_numbers_and_list_every_candidate(spark):
    ballots = spark.createDataFrame([("e", f"v{i}", "a") for i in range(100)], "election_id string, voter_id string, choice string")
    candidates = spark.createDataFrame([("e", "a"), ("e", "b"), ("f", "a")], "election_id string, candidate_id string")
    got = {(r["election_id"], r["candidate_id"]): r["votes"] for r in privacy.private_tally(ballots, candidates, 1.0, 1, "s", least=30).collect()}
    assert abs(got.pop(("e", "a")) - 100) < 30 and set(got.values()) == {None} and len(got) == 2
    ledger = spark.createDataFrame([("d", "r1", 1, 0.5), ("d", "r1", 1, 0.5), ("d", "r2", 2, 0.5), ("d", "r3", 3, 0.25), ("x", "r1", 1, 2.0)], "data string, release string, at int, epsilon double")
    assert {(r["data"], r["release"]): (r["spent"], r["allowed"]) for r in privacy.spent(ledger, 1.0).collect()} == {("d", "r1"): (0.5, True), ("d", "r2"): (1.0, True), ("d", "r3"): (1.25, False), ("x", "r1"): (2.0, False)}
    for epsilon, most in ((0, 1), (1.0, 0)):
        with pytest.raises(ValueError):
            privacy.private_tally(ballots, candidates, epsilon, most, "s")


@pytest.mark.parametrize("parts", [1, 9])
def test_frontiers_equal_all_pairs(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [("g" if i % 3 else "h", i, float(rng.integers(0, 40)), float(rng.integers(0, 40))) for i in range(600)] + [("k", 1000 + i, float(i), float(i)) for i in range(200)]
    rows += [("g", -1, None, 5.0), ("g", -2, float("nan"), 50.0), ("g", -3, 0.0, None)]
    frame = spark.createDataFrame(rows, "topic string, id long, cost double, benefit double")
    known = [r for r in rows if r[2] is not None and r[3] is not None and r[2] == r[2]]
    beaten = lambda r: any(q[0] == r[0] and q[2] <= r[2] and q[3] >= r[3] and q[2:] != r[2:] for q in known)
    want = {r[1] for r in known if not beaten(r)}
    assert {r["id"] for r in frontier.frontier(frame.repartition(parts), ["topic"]).collect()} == want
    quo = spark.createDataFrame([("g", 9001, 39.0, 0.0), ("h", 9002, -1.0, 99.0)], frame.schema)
    menu = {(r["topic"], r["id"], r["on_frontier"]) for r in frontier.menu(frame, ["topic"], quo).collect()}
    assert ("g", 9001, False) in menu and {m for m in menu if m[0] == "h"} == {("h", 9002, True)}


def test_facets_tell_proposals_apart_where_they_meet(spark, monkeypatch):
    from tallyforge.operators import spread

    monkeypatch.setattr(spread, "ROWS_AT_ONCE", 500)
    cells = [(None if i % 41 == 0 else i % 97, None if i % 5 == 0 else i % 7, None if i % 3 == 0 else i % 4, "abc"[i % 3] if i % 13 else None) for i in range(600)]
    rows = spark.createDataFrame(cells, "id long, domain_id int, program_id long, status string")
    found = listing.facets(rows)
    want = rows.cube("domain_id", "program_id", "status").agg(F.grouping_id().cast("long").alias("level"), F.count_distinct("id").alias("n"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(id#" in plan and ", 10), REPARTITION_BY_NUM" in plan


def test_sites_meet_their_voters_at_poles_and_the_date_line(spark):
    rng = np.random.default_rng(2)
    place = lambda n, start: [(start + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), strict=True))]
    edges = [(900, 90.0, 0.0), (901, -90.0, 17.0), (902, 0.0, 180.0), (903, 0.0, -180.0), (904, 89.5, -120.0), (905, -89.9, 60.0), (906, 45.0, 179.99), (907, 45.0, -179.99)]
    voters, sites = place(300, 0) + edges, place(40, 0) + edges
    v = spark.createDataFrame([*[(i, a, b, None, 0.5) for i, a, b in voters], (999, None, 1.0, 0.1, 0.1), (998, 95.0, 1.0, 0.1, 0.1)], "voter long, lat double, lon double, exposure double, stake double")
    s = spark.createDataFrame([*[(i, a, b, 1000 + i) for i, a, b in sites], (999, float("nan"), 1.0, 1)], "site long, lat double, lon double, population long")

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * jurisdiction.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    for radius in (250.0, 3000.0, 9000.0):
        got = [(r["voter"], r["site"]) for r in jurisdiction.within(v, s, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in voters for b in sites if km(a[1:], b[1:]) <= radius}
    with pytest.raises(ValueError):
        jurisdiction.within(v, s, 0)


def test_choices_are_summed_where_pairs_are_made(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(jurisdiction, "CROWD", 7)
    v = spark.createDataFrame([(i, float(rng.normal(48, 3)), float(rng.normal(2, 3)), 0.1 * (i % 9), None if i % 5 == 0 else 0.5, None if i % 11 == 0 else "abc"[i % 3]) for i in range(200)], "voter long, lat double, lon double, exposure double, stake double, choice string")
    s = spark.createDataFrame([(i, float(rng.uniform(40, 90)), float(rng.uniform(-20, 20)), None if i == 3 else 100 * i) for i in range(30)] + [(99, -50.0, 2.0, 10)], "site long, lat double, lon double, population long")
    pairs = v.join(s.select("site", F.col("lat").alias("y"), F.col("lon").alias("x"), "population")).withColumn("d", jurisdiction.distance_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")))
    pairs = pairs.withColumn("w", jurisdiction.weight(F.col("d"), F.col("exposure"), F.col("stake"), F.col("population"), 900.0)).filter("w > 0")
    assert {tuple(r) for r in pairs.select("site", "voter", "d", "w").collect()} == {tuple(r) for r in jurisdiction.weighted_voters(v, s, 900.0).collect()}
    want = {tuple(r) for r in pairs.groupBy("site", "choice").agg(F.sum("w")).collect()}
    summed = jurisdiction.weighted_choices(v, s, 900.0)
    assert {tuple(r) for r in summed.collect()} == want and len(want) > 30
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ASIN") == 2  # of a site's circle, and one distance for a pair


def test_sites_of_a_cell_are_not_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(jurisdiction, "CROWD", 7)
    v = spark.range(30).selectExpr("id AS voter", "1.0D + id / 100 AS lat", "1.0D AS lon", "0.5D AS exposure", "0.5D AS stake")
    s = spark.range(400).selectExpr("id AS site", "1.0D + id / 1000 AS lat", "1.5D AS lon", "id AS population")
    rows_held = ("spark.sql.sortMergeJoinExec.buffer.in.memory.threshold", "spark.sql.sortMergeJoinExec.buffer.spill.threshold")
    for key in rows_held:
        spark.conf.set(key, "25")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan itself holds the counts of its run
    try:
        found = jurisdiction.weighted_voters(v, s, 900.0)
        assert {(r["site"], r["voter"]) for r in found.collect()} == {(a, b) for a in range(400) for b in range(30)}
    finally:
        for key in (*rows_held, "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    joins = [n for n in nodes(found._jdf.queryExecution().executedPlan()) if n.nodeName() == "SortMergeJoin"]
    assert [n.metrics().apply("numOutputRows").value() for n in joins] == [12000]
    assert [n.metrics().apply("spillSize").value() for n in joins] == [0]


def test_sites_of_a_cell_meet_their_voters_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jurisdiction, "CROWD", 7)
    for voters, sites in ((5, 400), (400, 5), (30, 400)):
        v = spark.range(voters).selectExpr("id AS voter", "1.0D + id / 1000 AS lat", "1.0D AS lon", "0.5D AS exposure", "0.5D AS stake")
        s = spark.range(sites).selectExpr("id AS site", "1.0D + id / 1000 AS lat", "1.5D AS lon", "id AS population")
        found = jurisdiction.weighted_voters(v, s, 900.0).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r["site"], r["voter"]) for r in found) == [(a, b) for a in range(sites) for b in range(voters)]
        assert max(Counter(r["task"] for r in found).values()) < len(found) / 2
    named = F.create_map(F.lit("en"), F.lit("a"))
    assert jurisdiction.within(v.withColumn("voter_names", named), s.withColumn("site_names", named), 900.0).count() == voters * sites


def test_medians_of_skewed_elections(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(x), int(w)) for x, w in zip(rng.lognormal(0, 3, 4000).round(3), rng.integers(1, 9, 4000), strict=True)]
    rows += [("one", 5.0, 1), ("same", 2.5, 3), ("same", 2.5, 4), ("two", 1.0, 1), ("two", 9.0, 1), ("tie", 1.0, 1), ("tie", 2.0, 2), ("tie", 3.0, 3), ("wide", -1.7e308, 1), ("wide", 1.7e308, 1), ("wide", 0.0, 1)]
    rows += [("odd", None, 5), ("odd", float("nan"), 5), ("odd", 1.0, 0), ("odd", 1.0, None), ("far", float("-inf"), 1), ("far", 3.0, 1), ("far", float("inf"), 1), ("zero", -0.0, 1), ("zero", 0.0, 1)]
    got = {r["election_id"]: (r["median"], r["total_weight"]) for r in median.weighted_median(spark.createDataFrame(rows, "election_id string, value double, weight long").repartition(6), weight="weight", buckets=8).collect()}

    def plain(name):
        some, at = sorted((v, w) for e, v, w in rows if e == name), 0
        total = sum(w for _, w in some)
        for v, w in some:
            at += w
            if 2 * at >= total:
                return v, total

    assert got == {n: plain(n) for n in ("hot", "one", "same", "two", "tie", "wide", "far", "zero")}


def test_a_weight_counts_as_so_many_ballots(spark):
    rng = np.random.default_rng(9)
    names = list("abcde")
    rows = [("e", str(i), rng.permutation(names)[: int(rng.integers(0, 6))].tolist(), int(rng.integers(1, 5))) for i in range(60)]
    frame = spark.createDataFrame(rows, "election_id string, voter_id string, ranking array<string>, weight long")
    repeated = frame.withColumn("voter_id", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "weight"), lambda k: F.concat_ws("-", "voter_id", k)))).drop("weight")
    candidates = spark.createDataFrame([("e", n, i) for i, n in enumerate(names)], "election_id string, candidate_id string, ord int")
    told = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()))
    for method in (tally.borda, lambda b, c, **k: tally.approval(b.withColumnRenamed("ranking", "approvals"), c, **k), lambda b, c, **k: tally.plurality(b.withColumn("choice", F.get("ranking", F.lit(0))), c, **k)):
        columns = ("candidate_id", "votes")
        assert told(method(frame, candidates, weight="weight").counts, *columns) == told(method(repeated, candidates).counts, *columns)
    assert told(condorcet.pairwise_matrix(frame, candidates, weight="weight"), "a", "b", "votes") == told(condorcet.pairwise_matrix(repeated, candidates), "a", "b", "votes")
    rounds = ("round_number", "candidate_id", "votes")
    assert told(instant_runoff(frame, candidates, weight="weight").more["round_counts"], *rounds) == told(instant_runoff(repeated, candidates).more["round_counts"], *rounds)


def test_ranked_pairs_of_random_cycles(spark):
    rng = np.random.default_rng(21)
    matrices = {f"e{k}": rng.integers(0, 30, (7, 7)) for k in range(12)}
    rows = [(e, f"c{a}", f"c{b}", int(m[a, b])) for e, m in matrices.items() for a in range(7) for b in range(7) if a != b]
    candidates = spark.createDataFrame([(e, f"c{i}", i) for e in matrices for i in range(7)], "election_id string, candidate_id string, ord int")
    ballots = spark.createDataFrame([(e, "v", ["c0"]) for e in matrices], "election_id string, voter_id string, ranking array<string>")
    matrix = spark.createDataFrame(rows, "election_id string, a string, b string, votes long")
    edges = condorcet.ranked_pairs(ballots, candidates, matrix=matrix).more["edges"].collect()
    for e, m in matrices.items():
        order = [(r["winner"], r["loser"], r["status"]) for r in sorted((r for r in edges if r["election_id"] == e), key=lambda r: r["seq"])]
        reach = {f"c{i}": {f"c{i}"} for i in range(7)}
        statuses = sorted({s for _, _, s in order})
        for winner, loser, status in order:
            closes = winner in reach[loser]
            if not closes:
                for x in reach:
                    if winner in reach[x]:
                        reach[x] |= reach[loser]
            assert (status == "locked") == (not closes), statuses
        best = any(all(m[a, b] > m[b, a] for b in range(7) if b != a) for a in range(7))  # it wins before any edge is locked
        assert len(order) == (0 if best else sum(m[a, b] > m[b, a] for a in range(7) for b in range(7)))
    assert sum(r["status"] == "skipped" for r in edges) > 5


def test_ranked_pairs_of_many_candidates(spark):
    """A cycle of 150 candidates in which each beats the half behind it: locking takes seconds."""
    n = 150
    rows = [("e", f"c{a:03}", f"c{b:03}", (10 + (b - a) % n) if 0 < (b - a) % n < n / 2 else 1) for a in range(n) for b in range(n) if a != b]
    candidates = spark.createDataFrame([("e", f"c{i:03}", i) for i in range(n)], "election_id string, candidate_id string, ord int")
    ballots = spark.createDataFrame([("e", "v", ["c000"])], "election_id string, voter_id string, ranking array<string>")
    result = condorcet.ranked_pairs(ballots, candidates, matrix=spark.createDataFrame(rows, "election_id string, a string, b string, votes long"))
    began = time.monotonic()
    assert {r["status"] for r in result.more["edges"].collect()} == {"locked", "skipped"}
    assert time.monotonic() - began < 60
