"""Delegation chains, caps and concentration against hand cases and plain loops."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import delegation, ranges


def _frame(spark, rows):
    return spark.createDataFrame(rows, "topic string, voter long, delegate long, given_at int")


def _followed(links):
    """{voter: (final, depth, in_cycle, to_cycle)} by walking."""
    out = {}
    for v in links:
        seen, at = [v], links[v]
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        out[v] = (None, None, at == v, True) if at in seen else (at, len(seen), False, False)
    return out


def test_latest_statement_holds(spark):
    said = _frame(spark, [("t", 1, 2, 1), ("t", 1, 3, 5), ("t", 2, 3, 4), ("t", 2, None, 4), ("t", 3, 1, 1), ("t", 3, None, 2), ("t", 4, 4, 9), ("t", 5, 1, None), ("u", 1, 2, 1), (None, 1, 2, 3), ("t", None, 2, 3)])
    got = {(r.topic, r.voter): r.delegate for r in delegation.latest(said).collect()}
    assert got == {("t", 1): 3, ("t", 2): 3, ("t", 5): 1, ("u", 1): 2}


@pytest.mark.parametrize("hub", [2, 100_000])
def test_chains_cycles_and_hubs(spark, hub):
    pick = random.Random(5)
    links = {v: (pick.randrange(30) if v % 3 else 7) for v in range(10, 120)} | {7: 8, 8: 9, 20: 21, 21: 22, 22: 20, 23: 22}
    got = {r.voter: tuple(r)[2:] for r in delegation.resolved(_frame(spark, [("t", v, d, 0) for v, d in links.items()]), hub=hub).collect()}
    assert got == _followed(links)


def test_a_long_chain_takes_rounds_by_its_logarithm(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(delegation, "_round", lambda *a, f=delegation._round: rounds.append(1) or f(*a))
    n = 100_000
    chain = spark.range(n).select(F.lit("t").alias("topic"), F.col("id").alias("voter"), (F.col("id") + 1).alias("delegate"), F.lit(0).alias("given_at"))
    got = delegation.resolved(chain)
    assert got.agg(F.min("final"), F.max("final"), F.max("depth"), F.sum("depth")).first() == (n, n, n, n * (n + 1) // 2)
    assert len(rounds) <= 18


def test_empty_delegations(spark):
    none = _frame(spark, [])
    assert delegation.resolved(none).count() == 0
    accepted, kept = delegation.capped(none, 5)
    assert accepted.count() == kept.count() == 0
    assert delegation.concentration(spark.createDataFrame([], "topic string, power long")).count() == 0


def test_power_counts_abstaining_ends_and_cycles_as_lost(spark):
    links = {1: 3, 2: 3, 4: 5, 6: 7, 7: 6, 8: 99}
    chains = delegation.resolved(_frame(spark, [("t", v, d, 0) for v, d in links.items()]))
    voters = spark.createDataFrame([("t", v, v != 5) for v in range(1, 10)], "topic string, voter long, casts boolean")
    got = {r.voter: (r.own, r.received, r.lost) for r in delegation.power(chains, voters).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 2, 0), 4: (0, 0, 1), 5: (0, 0, 0), 6: (0, 0, 1), 7: (0, 0, 1), 8: (0, 0, 1), 9: (1, 0, 0)}


def test_the_last_delegation_is_cut_and_overflow_passes_on(spark):
    unit = delegation.UNIT
    # 10 has room for one and a half votes; the rest of the youngest goes to 20, which is full after 1 and a half
    rows = [("t", 1, 10, 1), ("t", 2, 10, 2), ("t", 3, 10, 3), ("t", 10, 20, 9), ("t", 4, 20, 4)]
    accepted, kept = delegation.capped(_frame(spark, rows), unit * 3 // 2)
    assert sorted(tuple(r)[1:] for r in accepted.collect()) == [(10, 1, unit), (10, 2, unit // 2), (20, 4, unit), (20, 10, unit // 2)]
    assert {r.voter: r.units for r in kept.collect()} == {1: 0, 2: unit // 2, 3: unit, 4: 0, 10: unit // 2}


def _caps(rows, cap):
    links = {v: d for _, v, d, _ in rows}
    offers, has, accepted = [(t, v, d, delegation.UNIT, {d}) for _, v, d, t in rows], defaultdict(int), defaultdict(int)
    while offers:
        rest, queue = [], defaultdict(list)
        for o in offers:
            queue[o[2]].append(o)
        for at, line in queue.items():
            for t, v, _, units, seen in sorted(line, key=lambda o: o[:2]):
                fits = max(0, min(units, cap - has[at]))
                has[at] += fits
                if fits:
                    accepted[at, v] += fits
                nxt = links.get(at)
                if fits < units and nxt is not None and nxt != v and nxt not in seen:
                    rest.append((t, v, nxt, units - fits, seen | {nxt}))
        offers = rest
    return dict(accepted)


@pytest.mark.parametrize("parts", [1, 7])
def test_caps_hold_and_weight_is_conserved_under_any_partitioning(spark, parts):
    pick = random.Random(3)
    rows = [("t", v, d, pick.randrange(4)) for v in range(60) if (d := pick.choice([0, 1, 2, v // 2, v // 3, (v + 1) % 60])) != v]
    cap = delegation.UNIT * 7 // 2
    accepted, kept = delegation.capped(_frame(spark, rows).repartition(parts), cap)
    got = {(r.delegate, r.voter): r.units for r in accepted.collect()}
    assert got == _caps(rows, cap)
    per, of = defaultdict(int), defaultdict(int)
    for (d, v), u in got.items():
        per[d] += u
        of[v] += u
    assert max(per.values()) == cap
    assert {r.voter: r.units for r in kept.collect()} == {v: delegation.UNIT - of[v] for _, v, _, _ in rows}


def test_halving_with_age(spark):
    got = spark.createDataFrame([(-5,), (0,), (9,), (10,), (25,), (10_000,)], "age int").select(delegation.halved(F.col("age"), 10)).collect()
    assert [r[0] for r in got] == [1_000_000, 1_000_000, 1_000_000, 500_000, 250_000, 0]


def test_concentration_against_loops(spark):
    pick = random.Random(1)
    topics = {"a": [pick.choice([0, 0, 1, 1, 1, 2, 50]) for _ in range(300)], "b": [4], "c": [0, 0], "d": [1] * 5}
    got = {r.topic: r for r in delegation.concentration(spark.createDataFrame([(t, x) for t, xs in topics.items() for x in xs] + [("a", None)], "topic string, power long")).collect()}
    for t, xs in topics.items():
        n, total, r = len(xs), sum(xs), got[t]
        assert (r.holders, r.total) == (n, total)
        if not total:
            assert r.gini is None and r.herfindahl is None and r.half_holders == 0
            continue
        gini = Fraction(2 * sum(i * x for i, x in enumerate(sorted(xs), 1)), n * total) - Fraction(n + 1, n)
        assert r.gini == pytest.approx(float(gini), abs=1e-12)
        assert r.herfindahl == pytest.approx(sum(x * x for x in xs) / total**2)
        need = next(k for k in range(1, n + 1) if 2 * sum(sorted(xs)[-k:]) >= total)
        assert r.half_holders == need


def test_running_sums_over_many_ranges(spark):
    pick = random.Random(2)
    rows = [("hot" if i % 5 else f"k{i % 7}", pick.randrange(50), i, pick.randrange(9)) for i in range(800)]
    frame = spark.createDataFrame(rows, "k string, o int, i int, v int")
    got = {r.i: r.before for r in ranges.running_sums(frame, ["k"], ["o", "i"], {"before": "v"}).collect()}
    seen, want = defaultdict(int), {}
    for k, _, i, v in sorted(rows):
        want[i] = seen[k]
        seen[k] += v
    assert got == want


def test_long_ways_into_cycles_and_random_graphs(spark):
    rng = random.Random(6)
    graphs = {"way": {**{i: i + 1 for i in range(70)}, 70: 68, 200: 30}, "ring": {i: (i + 1) % 33 for i in range(33)}, "chain": {i: i + 1 for i in range(40)}}
    graphs |= {f"r{k}": {i: d for i in range(60) if (d := rng.randrange(70)) != i and rng.random() < 0.9} for k in range(12)}
    rows = [(t, v, d) for t, g in graphs.items() for v, d in g.items()]
    frame = spark.createDataFrame(rows, "topic string, voter long, delegate long")
    got = {(r["topic"], r["voter"]): (r["final"], r["depth"], r["in_cycle"], r["to_cycle"]) for r in delegation.resolved(frame).collect()}
    for (topic, voter), told in got.items():
        g, at, seen = graphs[topic], voter, []
        while at in g and at not in seen:
            seen.append(at)
            at = g[at]
        assert told == ((None, None, at == voter or at in seen and seen.index(at) == 0, True) if at in seen else (at, len(seen), False, False))
    assert len(got) == len(rows)
