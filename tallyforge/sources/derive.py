"""Ballots and candidates derived from the trade tables, so every method runs on real rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FLAGS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candidates(elections: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    listed = F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("ord", "candidate_id")
    return elections.select("election_id", listed).select("election_id", "candidate_id", F.col("candidate_id").alias("name"), "ord")


def single_choice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ballot per event: its type, for the week's election; some abstain, some name an unknown id."""
    choice = F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 23 == 0, "unknown").otherwise(F.col("event_type"))
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    ballots = table(spark, sf_dir, "events").select(week.alias("election_id"), F.col("event_id").cast("string").alias("voter_id"), choice.alias("choice"))
    return ballots, _candidates(ballots.select("election_id").distinct(), (*EVENT_TYPES, "ghost"))


def approval(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ballot per customer: the priorities of its orders; every tenth customer abstains."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("used"))
    customers = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    approvals = F.when(F.col("c_custkey") % 10 == 0, F.array().cast("array<string>")).otherwise(F.coalesce("used", F.array().cast("array<string>")))
    ballots = customers.select(F.col("c_mktsegment").alias("election_id"), F.col("c_custkey").cast("string").alias("voter_id"), approvals.alias("approvals"))
    return ballots, _candidates(ballots.select("election_id").distinct(), PRIORITIES)


def score(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ballot per order and line status: each return flag's highest discount in hundredths."""
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("election_id"), F.col("l_orderkey").cast("string").alias("voter_id"), "l_returnflag").agg(F.max(F.round(F.col("l_discount") * 100).cast("int")).alias("s"))
    ballots = best.groupBy("election_id", "voter_id").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "s"))).alias("scores"))
    return ballots, _candidates(ballots.select("election_id").distinct(), FLAGS)


def ranked(spark: SparkSession, sf_dir: str, by: str = "c_nationkey") -> tuple[DataFrame, DataFrame]:
    """A ballot per customer: the priorities it used, most used first, then by highest price; elections by ``by``."""
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("p"))
    lists = used.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("p")).alias("p"), "o_orderpriority"))).alias("l"))
    customers = table(spark, sf_dir, "customer").join(lists, "c_custkey", "left")
    ranking = F.coalesce(F.transform("l", lambda x: x["o_orderpriority"]), F.array().cast("array<string>"))
    ballots = customers.select(F.col(by).cast("string").alias("election_id"), F.col("c_custkey").cast("string").alias("voter_id"), ranking.alias("ranking"))
    return ballots, _candidates(ballots.select("election_id").distinct(), PRIORITIES)


def quadratic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ballot per user: signed votes from its events by type; 'view' is no candidate, some users abstain."""
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    votes = ((1 + F.col("n") % 5) * F.when(F.col("event_type") == "error", -1).otherwise(1)).cast("int")
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_type"), votes))).alias("m"))
    ballots = maps.select(
        (F.col("user_id") % 4).cast("string").alias("election_id"), F.col("user_id").cast("string").alias("voter_id"),
        F.when(F.col("user_id") % 13 != 0, F.col("m")).alias("allocations"), F.when(F.col("user_id") % 7 == 0, 60).otherwise(100).alias("credit_budget"),
    )
    return ballots, _candidates(ballots.select("election_id").distinct(), ("click", "error", "purchase", "signup"))


def delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements (topic, voter, delegate, given_at): each order is one of its customer on the topic of its priority.

    Most name a customer of a third of the number, so that chains are trees; others a neighbour, which makes long chains
    and cycles, customer 0, who becomes a hub, or nobody, which withdraws.
    """
    key, voter = F.col("o_orderkey"), F.col("o_custkey")
    named = F.when(key % 6 == 0, F.lit(None).cast("long")).when(key % 10 == 1, F.lit(0).cast("long")).when(key % 10 == 3, voter + 1 - 2 * (voter % 2)).when(key % 3 == 1, voter - 1)
    delegate = F.when(key % 6 == 0, named).otherwise(F.coalesce(named, F.floor(voter / 3)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic"), voter.alias("voter"), delegate.alias("delegate"), F.col("o_orderdate").alias("given_at"))


def topic_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, voter, casts): every customer for every priority; some cast no ballot."""
    topics = F.explode(F.array(*[F.lit(p) for p in PRIORITIES])).alias("topic")
    return table(spark, sf_dir, "customer").select(topics, F.col("c_custkey").alias("voter"), (F.col("c_custkey") % 9 != 4).alias("casts"))


def weighted(derived, spark: SparkSession, sf_dir: str, **named) -> tuple[DataFrame, DataFrame]:
    """Ballots and candidates of one of the functions above, with a weight of 1, 2 or 3 by the voter's number."""
    ballots, candidates = derived(spark, sf_dir, **named)
    return ballots.withColumn("weight", F.col("voter_id").cast("long") % 3 + 1), candidates


def located_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as voters spread over the globe: (voter, lat, lon, exposure, stake)."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("voter"), (((key * 7919) % 18001) / 100 - 90).alias("lat"), (((key * 104729) % 36000) / 100 - 180).alias("lon"), ((key % 11) / 10).alias("exposure"), (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10000).alias("stake")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites: (site, lat, lon, population)."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("site"), (((key * 3571) % 18001) / 100 - 90).alias("lat"), (((key * 15485863) % 36000) / 100 - 180).alias("lon"), (1000 + (key % 97) * 5000).alias("population"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballots along a line: a line item's discounted price for its ship mode's year, weighed by its quantity; some name none."""
    price = F.when(F.col("l_orderkey") % 13 != 0, F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2))
    return table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("election_id"), price.alias("value"), F.col("l_quantity").cast("long").alias("weight"))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes (proposal, at, status): the orders of a customer, one of six statuses by the order's number."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("draft", "submitted", "voting", "passed", "enacted", "repealed")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("proposal"), F.col("o_orderdate").alias("at"), status.alias("status"))


def proposal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes (proposal, voter, at): line items; a third of all are on one proposal."""
    proposal = F.when(F.col("l_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select(proposal.alias("proposal"), F.col("l_suppkey").alias("voter"), F.col("l_shipdate").alias("at"))


def filed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Proposals (id, status, created_at) and topics (proposal_id, domain_id, program_id): orders and their lines; some have no topic."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    number = F.col("l_linenumber")
    topics = table(spark, sf_dir, "lineitem").filter("l_orderkey % 10 <> 3").select(F.col("l_orderkey").alias("proposal_id"), (number % 5).alias("domain_id"), F.when(number % 3 != 0, F.col("l_suppkey") % 25).alias("program_id"))
    return orders, topics


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options (brand, id, cost, benefit): parts by their price, in tens, and size."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.floor(F.col("p_retailprice") / 10).alias("cost"), F.col("p_size").alias("benefit"))


def draft_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of proposals and their drafts (id, vector), in whole numbers: two reworded ones, a copy of every tenth, a zero one of every 25th."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("draft"), F.col("embedding").alias("e"))
    rows = rows.filter("draft < 3 OR draft = 3 AND vec_id % 10 = 0 OR draft = 4 AND vec_id % 25 = 0")
    moved = lambda x, i: F.floor(x * 1000) + F.when(F.col("draft") < 3, F.col("draft") * 15 * ((F.col("vec_id") * 31 + F.col("draft") * 17 + (i + 1) * 7 + F.col("vec_id") % 3 * i) % 5 - 2)).otherwise(0)
    vector = F.transform("e", lambda x, i: F.when(F.col("draft") < 4, moved(x, i)).otherwise(0).cast("double"))
    return rows.select((F.col("vec_id") * 5 + F.col("draft")).alias("id"), vector.alias("vector"))
