"""Delegation of votes by topic: chains, cycles, inbound caps, decay with age, and the power that results.

Delegations are rows (topic, voter, delegate, given_at), at most one for a topic and voter; see :func:`latest`. A voter
without one votes for itself. Chains are followed by pointer doubling: each round every open row takes over its delegate's
pointer of the round before, so that rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import stored
from .ranges import running_sums

#: A delegate whom more open rows point at is a hub: its row is spread over several tasks.
HUB = 100_000
#: At most so many hubs are sent to every task; the size from which a delegate is one grows to keep to it.
MAX_HUBS = 20_000
#: A whole vote, in the units that weights are counted in.
UNIT = 1_000_000


def latest(statements: DataFrame) -> DataFrame:
    """The delegations that hold: of each topic and voter the last statement by (given_at, delegate).

    A statement with a null delegate, or that names the voter, withdraws an earlier one. Rows without topic or voter are
    left out; without a time they come first.
    """
    last = F.max_by(F.struct("delegate", "given_at"), F.struct("given_at", "delegate")).alias("s")
    held = statements.filter("topic IS NOT NULL AND voter IS NOT NULL").groupBy("topic", "voter").agg(last)
    return held.select("topic", "voter", "s.delegate", "s.given_at").filter("delegate IS NOT NULL AND delegate <> voter")


def _hubs(rows: DataFrame, hub: int) -> DataFrame:
    """(topic, at, salts) of the delegates that more than ``hub`` open rows point at; at most MAX_HUBS of them."""
    size = max(hub, math.ceil(rows.count() / MAX_HUBS))
    counts = rows.groupBy("topic", "at").agg(F.count("*").alias("n")).filter(F.col("n") > size)
    return counts.select("topic", "at", F.ceil(F.col("n") / size).cast("int").alias("salts"))


def _round(open_: DataFrame, known: DataFrame, hub: int) -> DataFrame:
    """Each open row with its pointer's row put in its place; a pointer that delegates to nobody is its end."""
    hubs = F.broadcast(_hubs(open_, hub))
    asked = open_.join(hubs, ["topic", "at"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("voter"), F.col("salts")), F.lit(0).cast("long")))
    ahead = known.select("topic", F.col("voter").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("ended").alias("_ended"))
    ahead = ahead.join(hubs, ["topic", "at"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts") - 1, F.lit(0)).cast("long")))).drop("salts")
    met = asked.drop("salts").join(ahead.hint("merge"), ["topic", "at", "salt"], "left")
    return met.select(
        "topic", "voter", F.coalesce("_at", "at").alias("at"), (F.col("depth") + F.coalesce("_depth", F.lit(0).cast("long"))).alias("depth"), (F.col("_at").isNull() | F.col("_ended")).alias("ended")
    )


def resolved(delegations: DataFrame, hub: int = HUB) -> DataFrame:
    """(topic, voter, final, depth, in_cycle, to_cycle) for every delegation.

    ``final`` is the voter at the chain's end and ``depth`` the number of steps to it. A chain that runs into a cycle has
    no end: both are null, ``to_cycle`` is true, and ``in_cycle`` is true for the voters on the cycle itself. Rounds: one
    more than the logarithm of the longest chain; with cycles, of the number of delegations.
    """
    open_ = stored(delegations.select("topic", "voter", F.col("delegate").alias("at"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("ended")), "delegations", tidy=True)
    ended: list[DataFrame] = []
    steps, every = 1, open_.count()
    pointed = lambda rows: rows.select("topic", "at").distinct().count()
    while steps <= every and not open_.isEmpty():  # after more steps than there are delegations what is open runs in a cycle
        now = stored(_round(open_, reduce(DataFrame.unionByName, [open_, *ended]), hub), "delegations", tidy=True)
        ended.append(now.filter("ended"))
        before, open_, steps = open_, now.filter(~F.col("ended")), 2 * steps
        if ended[-1].isEmpty() and pointed(before) == pointed(open_):
            break
    on = open_.select("topic", F.col("at").alias("voter")).distinct().withColumn("on", F.lit(True))
    looped = open_.join(on, ["topic", "voter"], "left")
    none, yes = F.lit(None), F.lit(True)
    looped = looped.select("topic", "voter", none.cast(dict(open_.dtypes)["at"]).alias("final"), none.cast("long").alias("depth"), F.coalesce("on", F.lit(False)).alias("in_cycle"), yes.alias("to_cycle"))
    done = [e.select("topic", "voter", F.col("at").alias("final"), "depth", F.lit(False).alias("in_cycle"), F.lit(False).alias("to_cycle")) for e in ended]
    return reduce(DataFrame.unionByName, [*done, looped])


def power(chains: DataFrame, voters: DataFrame) -> DataFrame:
    """(topic, voter, own, received, lost): votes that each of ``voters`` (topic, voter, casts) ends up with.

    ``own`` is 1 for who casts a ballot and delegates to nobody; ``received`` are the votes whose chains end there. An end
    that casts none abstains, and so do chains that run into a cycle: such votes are ``lost`` at their voter's own row.
    """
    got = chains.filter("final IS NOT NULL").groupBy("topic", F.col("final").alias("voter")).agg(F.count("*").alias("received"))
    ends = voters.select("topic", F.col("voter").alias("final"), F.col("casts").alias("_casts"))
    own = chains.join(ends.hint("merge"), ["topic", "final"], "left").select("topic", "voter", F.lit(True).alias("_gives"), F.coalesce("_casts", F.lit(False)).alias("_arrives"))
    rows = voters.select("topic", "voter", "casts").join(got, ["topic", "voter"], "left").join(own, ["topic", "voter"], "left")
    gives, zero = F.coalesce("_gives", F.lit(False)), F.lit(0).cast("long")
    return rows.select(
        "topic", "voter", F.when(F.col("casts") & ~gives, 1).otherwise(0).cast("long").alias("own"), F.when(F.col("casts") & ~gives, F.coalesce("received", zero)).otherwise(zero).alias("received"),
        F.when(gives & ~F.col("_arrives"), 1).otherwise(0).cast("long").alias("lost"),
    )


def halved(age: Column, half_life: int) -> Column:
    """The units of a vote that a delegation of ``age`` whole days still passes on: half as many after each half life."""
    steps = F.floor(F.greatest(age, F.lit(0)) / F.lit(half_life))
    return F.call_function("shiftright", F.lit(UNIT).cast("long"), F.least(steps, F.lit(62)).cast("int"))


def capped(delegations: DataFrame, cap: int, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Delegation under an inbound cap, in units: (topic, delegate, voter, units) accepted, (topic, voter, units) kept.

    ``weight`` gives the units of each delegation (a whole vote without it); what is left of the vote stays with the
    voter. Each delegate accepts what it is offered, the oldest delegation first (then by voter), until the sum reaches
    ``cap`` units; the last one is cut exactly. What it cannot accept goes to its own delegate in the next round, behind
    what that one has accepted before. What reaches the end of a chain, comes back to its voter or goes round a cycle of
    full delegates stays with the voter. Units are whole numbers: none is lost or made, and neither the order of rows nor
    of tasks changes the result. There are as many rounds as delegates that the farthest overflow passes.
    """
    given = delegations.withColumn("units", F.greatest(F.lit(0), F.least(F.lit(UNIT), F.lit(UNIT) if weight is None else weight)).cast("long"))
    given = stored(given.select("topic", "voter", "delegate", "given_at", "units"), "capped", tidy=True)
    ahead = given.select("topic", F.col("voter").alias("at"), F.col("delegate").alias("_next"))
    # a delegate that an offer passed earlier, moved up after 1, 2, 4 ... steps: met again, the offer goes round
    offers = given.filter("units > 0").select("topic", "voter", F.col("delegate").alias("at"), "given_at", "units", F.col("delegate").alias("mark"))
    taken: list[DataFrame] = []
    step = 0
    while not offers.isEmpty():
        queue = running_sums(offers, ["topic", "at"], [F.col("given_at").asc_nulls_first(), F.col("voter")], {"before": "units"})
        has = F.lit(0).cast("long")
        if taken:
            held = reduce(DataFrame.unionByName, taken).groupBy("topic", F.col("delegate").alias("at")).agg(F.sum("units").alias("_has"))
            queue, has = queue.join(held.hint("merge"), ["topic", "at"], "left"), F.coalesce("_has", has)
        fits = F.greatest(F.least(F.col("units"), F.lit(cap) - has - F.col("before")), F.lit(0)).cast("long")
        queue = stored(queue.withColumn("fits", fits).select("topic", "voter", "at", "given_at", "units", "mark", "fits"), "capped", tidy=True)
        taken.append(queue.filter("fits > 0").select("topic", F.col("at").alias("delegate"), "voter", F.col("fits").alias("units")))
        step += 1
        moved = step & (step - 1) == 0
        rest = queue.filter("fits < units").join(ahead.hint("merge"), ["topic", "at"]).filter((F.col("_next") != F.col("voter")) & (F.col("_next") != F.col("mark")))
        offers = rest.select("topic", "voter", F.col("_next").alias("at"), "given_at", (F.col("units") - F.col("fits")).alias("units"), (F.col("_next") if moved else F.col("mark")).alias("mark"))
        offers = stored(offers, "capped", tidy=True)
    accepted = reduce(DataFrame.unionByName, taken) if taken else given.limit(0).select("topic", "delegate", "voter", "units")
    gone = accepted.groupBy("topic", "voter").agg(F.sum("units").alias("_gone"))
    kept = given.join(gone.hint("merge"), ["topic", "voter"], "left").select("topic", "voter", (F.lit(UNIT).cast("long") - F.coalesce("_gone", F.lit(0).cast("long"))).alias("units"))
    return accepted, kept


def concentration(holders: DataFrame, value: str = "power") -> DataFrame:
    """(topic, holders, total, gini, herfindahl, half_holders) of ``holders`` (topic, value), values whole and not negative.

    Holders of equal values are counted together first; ranks and sums below a value come from :func:`running_sums` over
    these counts, so that no task holds a topic. ``half_holders`` is the least number of holders with at least half of
    the total. Null values are left out; a topic whose values are all zero has null ratios and needs no holder.
    """
    counts = holders.filter(F.col(value).isNotNull()).groupBy("topic", F.col(value).cast("long").alias("x")).agg(F.count("*").alias("c")).withColumn("m", F.col("x") * F.col("c"))
    totals = counts.groupBy("topic").agg(F.sum("c").alias("holders"), F.sum("m").alias("total"))
    below = running_sums(counts, ["topic"], ["x"], {"rank": "c", "sum": "m"}).join(totals, "topic")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = (wide("x") * wide("c")).cast("decimal(38,0)") * (2 * F.col("rank") + F.col("c") + 1).cast("decimal(19,0)")  # twice the sum of the ranks of these holders, times x
    above = F.col("total") - F.col("sum") - F.col("m")  # what larger holders have
    still = F.ceil((F.col("total") - 2 * above) / (2 * F.col("x"))).cast("long")  # of these, so that half is reached
    reached = (2 * above < F.col("total")) & (2 * (above + F.col("m")) >= F.col("total")) & (F.col("x") > 0)
    parts = below.groupBy("topic", "holders", "total").agg(
        F.sum(ranked.cast("decimal(38,0)")).alias("ranks"), F.sum(F.col("x").cast("double") * F.col("m")).alias("squares"), F.coalesce(F.max(F.when(reached, F.col("holders") - F.col("rank") - F.col("c") + still)), F.lit(0).cast("long")).alias("half_holders")
    )
    n, total = F.col("holders").cast("double"), F.nullif(F.col("total"), F.lit(0)).cast("double")
    return parts.select("topic", "holders", "total", (F.col("ranks").cast("double") / (n * total) - (n + 1) / n).alias("gini"), (F.col("squares") / (total * total)).alias("herfindahl"), "half_holders")
