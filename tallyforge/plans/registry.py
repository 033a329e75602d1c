"""The registered queries: each applies an operator of the library to frames derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ballots as B
from ..operators import changes, condorcet, delegation, elections, frontier, jurisdiction, lifecycle, listing, median, privacy, proposals, similar, tally
from ..operators.irv import instant_runoff, unknown_ids
from ..operators.spread import spread
from ..sources import derive
from ..sources.derive import table
from ..sources.scratch import stored
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _told(header: DataFrame) -> DataFrame:
    """winners as the one id (null if none), ratios to nine places."""
    rounded = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in header.dtypes if c != "winners"]
    return header.select(*rounded, F.get("winners", F.lit(0)).alias("winners"))


def _counts(counts: DataFrame) -> DataFrame:
    return counts.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in counts.dtypes if c != "ord"])


def _tallied(derived, method, part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = method(*derived(spark, sf_dir))
        return _told(result.header) if part == "header" else _counts(result.counts)

    return run


def _ballots(derived, select: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: select(derived(spark, sf_dir)[0])


def _pairwise(select: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ballots, candidates = derive.ranked(spark, sf_dir)
        return select(condorcet.margins(condorcet.pairwise_matrix(ballots, candidates)), candidates)

    return run


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derive.ranked(spark, sf_dir, "c_mktsegment")


def ballot_validate_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ballots, candidates = derive.ranked(spark, sf_dir)
    ids = candidates.groupBy("election_id").agg(F.collect_list("candidate_id").alias("ids"))
    return B.checked(ballots.join(ids, "election_id"), B.ranked_error("ranking", "ids"), strict=False).select("voter_id", "error")


def ranked_pairs_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condorcet.ranked_pairs(*derive.ranked(spark, sf_dir)).more["edges"].select("election_id", "seq", "winner", "loser", "margin", "status")


def ranked_pairs_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(condorcet.ranked_pairs(*derive.ranked(spark, sf_dir)).header)


def irv_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = instant_runoff(*_segments(spark, sf_dir)).more["rounds"]
    return rounds.withColumn("eliminated", F.array_join("eliminated", ","))


def irv_round_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instant_runoff(*_segments(spark, sf_dir)).more["round_counts"]


def irv_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(instant_runoff(*_segments(spark, sf_dir)).header)


def nested_author_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposals, customers as authors, nations as programs in regions as domains."""
    nations = proposals.with_parent(table(spark, sf_dir, "nation"), "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey", ["r_name"], "domain")
    authors = proposals.with_parent(table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey", ["n_name", "domain"], "program")
    loaded = proposals.with_parent(table(spark, sf_dir, "orders"), "o_custkey", authors, "c_custkey", ["c_custkey", "c_name", "program"], "author")
    return loaded.select(F.col("o_orderkey").alias("id"), F.col("author.c_custkey").alias("author_id"), F.col("author.c_name").alias("handle"), F.col("author.program.n_name").alias("program"), F.col("author.program.domain.r_name").alias("domain"))


def nested_children_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = proposals.children(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"], "items")
    loaded = proposals.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", items, "items")
    told = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"], i["l_partkey"])), ",")
    return loaded.select(F.col("o_orderkey").alias("id"), told.alias("items"), F.size("items").alias("n_items"))


def programs_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(True).alias("active"))
    programs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("domain_id"), F.col("n_name").alias("name"), F.lit(True).alias("active"))
    return proposals.domains_with_programs(domains, programs).select("id", "name", F.array_join(F.transform("programs", lambda p: p["name"]), ",").alias("programs"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_quantity").cast("int").alias("one_time_usd"), (F.col("l_linenumber") * 10).cast("int").alias("annual_usd"))


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return proposals.orphans(table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey").select("c_custkey")


def _uuid_of(key: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(key.cast("string"), 12, "0"))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposal forms whose actions, metrics and budget items are their lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    # a line is gathered as its two numbers; its texts are made of the list
    n = lines.count()
    lists = spread(lines, n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("l"))
    text = lambda x: x["l_linenumber"].cast("string")
    metric = lambda x: F.struct(
        text(x).alias("name"), F.lit("count").alias("unit"), text(x).alias("baseline_val"), F.when(x["l_linenumber"] % 2 == 0, 2000 + x["l_linenumber"]).alias("baseline_year"),
        F.concat(F.lit("census "), text(x)).alias("baseline_source"), text(x).alias("target_val"), F.lit("2030-01-01").alias("deadline"),
    )
    item = lambda x: F.struct(text(x).alias("item_name"), (x["q"] - 2).alias("one_time_usd"), F.lit(0).alias("annual_usd"), F.lit(0.5).alias("confidence"))
    key = F.col("o_orderkey")
    note = lambda name: F.concat(F.lit(f"{name} "), (key % 7).cast("string")).alias(name)
    topics = F.array(*[F.struct(_uuid_of(key + i).alias("domain_id"), (F.lit(None).cast("string") if i else _uuid_of(key * 2)).alias("program_id"), F.lit(i == 0).alias("is_primary")) for i in range(2)])
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), n, "o_orderkey").join(lists, key == F.col("l_orderkey"), "left").select(
        key.alias("id"), F.repeat(F.lit("x"), (key % 70).cast("int")).alias("title"), F.lit("summary").alias("summary"), F.lit("problem").alias("problem_plain"),
        F.transform("l", lambda x: F.struct(text(x).alias("text"))).alias("actions"), F.transform("l", metric).alias("metrics"), F.transform("l", item).alias("budget_items"), topics.alias("topics"),
        *[note(c) for c in ("implementing_org", "scope_geojson", "population_source", "funding_notes", "legal_citation", "equity_beneficiaries", "equity_cost_bearers")],
        *[note(c) for c in ("safeguards_rollback_trigger", "safeguards_rollback_steps", "privacy_notes")],
        F.when(key % 4 == 0, "").when(key % 4 == 1, "2031-05-01").alias("sunset_date"),
        F.when(key % 5 == 0, 0).otherwise(100).alias("population_estimate"), F.lit(False).alias("needs_new_authority"), F.lit(30).alias("retention_days"),
        F.when(key % 11 == 0, F.lit("nobody")).otherwise(_uuid_of(key)).alias("author_id"),
    )


def proposal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.form_errors(_forms(spark, sf_dir)).select("id", F.array_join("errors", ",").alias("errors"))


def proposal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of which some break each part of each rule."""
    key = F.col("id")
    forms = _forms(spark, sf_dir)

    def spoilt(entries: str, field: str, at: str, when: Column, value) -> Column:
        """The list with one field of the entry named ``at`` replaced on some forms."""
        name = {"actions": "text", "metrics": "name", "budget_items": "item_name"}[entries]
        return F.transform(entries, lambda x: F.when(when & (x[name] == at), x.withField(field, F.lit(value))).otherwise(x))

    for entries, field, at, when, value in [
        ("actions", "text", "1", key % 6 == 0, ""),
        *[("metrics", f, "2", key % 7 == i + 1, "") for i, f in enumerate(("unit", "baseline_val", "target_val", "deadline", "name"))],
        ("budget_items", "annual_usd", "1", key % 12 == 1, -1), ("budget_items", "confidence", "1", key % 12 == 2, 1.5), ("budget_items", "confidence", "1", key % 12 == 3, None), ("budget_items", "item_name", "1", key % 12 == 4, ""),
    ]:
        forms = forms.withColumn(entries, spoilt(entries, field, at, when, value))
    topic = lambda t: F.when(key % 8 == 1, t.withField("domain_id", F.lit("x"))).when(key % 8 == 2, t.withField("program_id", F.lit("p"))).when(key % 8 == 3, t.withField("is_primary", F.lit(None).cast("boolean"))).otherwise(t)
    forms = forms.withColumns({
        "topics": F.when(key % 8 != 0, F.transform("topics", topic)), "summary": F.repeat(F.lit("s"), (key % 300).cast("int")), "problem_plain": F.repeat(F.lit("p"), (key % 17 * 100).cast("int")),
        "needs_new_authority": F.when(key % 9 != 4, F.lit(True)), "retention_days": F.when(key % 10 == 3, 0).when(key % 10 == 4, -5).when(key % 10 != 5, 30),
        "population_estimate": F.when(key % 13 == 0, -1).when(key % 13 != 1, 100), "author_id": F.when(key % 11 != 1, F.col("author_id")),
    })
    return proposals.form_errors(forms).select("id", F.array_join("errors", ",").alias("errors"))


def _form_rows(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = proposals.form_rows(_forms(spark, sf_dir))[name]
        return rows.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in rows.dtypes])

    return run


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as proposals of customers, lines as their topics, metrics, actions and budget items, nations as programs of regions."""
    lines, number = table(spark, sf_dir, "lineitem").withColumn("proposal_id", F.col("l_orderkey")), F.col("l_linenumber")
    return {
        "app_user": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("handle")),
        "domain": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(True).alias("active")),
        "program": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("domain_id"), F.col("n_name").alias("name"), F.lit(True).alias("active")),
        "proposal": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("author_id"), F.lit("draft").alias("status"), F.col("o_orderpriority").alias("title")),
        "proposal_topic": lines.select("proposal_id", (number % 5).alias("domain_id"), F.when(number % 3 != 0, F.col("l_suppkey") % 25).alias("program_id"), (number == 1).alias("is_primary")),
        "proposal_metric": lines.select(
            number.alias("id"), "proposal_id", F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("unit"), F.col("l_quantity").alias("baseline_val"), F.lit(2020).alias("baseline_year"),
            F.lit("count").alias("baseline_source"), F.col("l_quantity").alias("target_val"), F.lit("2030-01-01").cast("date").alias("deadline"),
        ),
        "proposal_action": lines.select(number.alias("id"), "proposal_id", number.alias("ordinal"), F.col("l_linestatus").alias("text")),
        "proposal_budget_item": lines.select(number.alias("id"), "proposal_id", F.col("l_returnflag").alias("item_name"), F.col("l_quantity").cast("int").alias("one_time_usd"), F.lit(0).alias("annual_usd"), F.lit(0.5).alias("confidence")),
    }


def _told_topics() -> Column:
    return F.array_join(F.transform("topics", lambda t: F.concat_ws(":", t["domain"]["name"], F.coalesce(t["program"]["name"], F.lit("-")), t["is_primary"].cast("string"))), ",").alias("topics")


def proposals_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _store(spark, sf_dir)
    loaded = proposals.proposals_loaded(t["proposal"], t["app_user"], t["proposal_topic"], t["domain"], t["program"], t["proposal_metric"], t["proposal_action"], t["proposal_budget_item"])
    told = lambda name, each: F.array_join(F.transform(name, each), ",").alias(name)
    return loaded.select(
        "id", F.col("author.handle").alias("handle"), _told_topics(), told("metrics", lambda m: F.concat_ws(":", m["name"], m["id"], m["unit"], m["baseline_val"].cast("int"))),
        told("actions", lambda a: F.concat_ws(":", a["ordinal"], a["text"])), told("budget_items", lambda i: F.concat_ws(":", i["item_name"], i["id"], i["one_time_usd"])),
    )


def proposals_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _store(spark, sf_dir)
    loaded = proposals.proposals_loaded(t["proposal"], t["app_user"], t["proposal_topic"], t["domain"], t["program"])
    return loaded.select("id", F.col("author.id").alias("author_id"), _told_topics())


def rows_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as new budget items: what they leave out gets its default."""
    number = F.col("l_linenumber")
    new = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", number).alias("id"), F.col("l_orderkey").cast("string").alias("proposal_id"), F.col("l_returnflag").alias("item_name"), F.when(number % 2 == 0, F.col("l_quantity").cast("int")).alias("one_time_usd")
    )
    return changes.with_defaults("proposal_budget_item", new).withColumn("confidence", F.col("confidence").cast("double"))


def rows_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some proposals change their status and lose their author; ids that are not there change nothing."""
    rows = _store(spark, sf_dir)["proposal"]
    new = rows.filter("id % 5 = 0").select(F.when(F.col("id") % 10 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.lit("passed").alias("status"), F.lit(None).cast("long").alias("author_id"))
    return changes.updated(rows, new)


def rows_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after every seventh proposal is deleted with all that hangs on it."""
    t = _store(spark, sf_dir)
    left = changes.deleted(t, "proposal", t["proposal"].filter("id % 7 = 0").select("id"))
    counts = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in sorted(left)]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def delete_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _store(spark, sf_dir)
    return changes.restricted(t, "app_user", t["app_user"].filter("id % 2 = 0").select("id"))


def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that break when regions and customers are missing and two nations share an id."""
    t = _store(spark, sf_dir)
    t["domain"], t["app_user"] = t["domain"].filter("id <> 3"), t["app_user"].filter("id % 50 <> 1")
    t["program"] = t["program"].withColumn("id", F.when(F.col("id") == 7, 8).otherwise(F.col("id")))
    return changes.violations({n: t[n] for n in ("domain", "app_user", "program", "proposal", "proposal_topic")})


def input_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as typed into a form, some of them no numbers."""
    quantity, number = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    typed = F.when(number == 1, F.concat(quantity, F.lit("abc"))).when(number == 2, "").when(number == 3, F.concat(F.lit("  -"), quantity, F.lit(".75"))).when(number == 4, "none").when(number == 5, F.lit("0")).otherwise(F.concat(F.lit("0.0"), quantity))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", typed.alias("typed"))
    return rows.select("l_orderkey", "l_linenumber", proposals.parsed_int("typed").alias("as_int"), proposals.int_or_zero("typed").alias("or_zero"), proposals.confidence_or_half("typed").alias("confidence"))


def _set_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An election of each ballot type, and of one that is unknown, for every region, with all kinds of faults."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    kinds = F.posexplode(F.array(*[F.lit(k) for k in (*elections.BALLOT_TYPES, "plurality")])).alias("k", "ballot_type")
    rows = table(spark, sf_dir, "region").join(names, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", "names", kinds)
    some, key = F.slice("names", 1, (F.col("r_regionkey") + F.col("k")) % 5), F.col("r_regionkey")
    return rows.select(
        F.when((key + F.col("k")) % 5 == 0, "  ").otherwise(F.concat(F.lit("  Election of "), "r_name", F.lit("\t "))).alias("title"), F.concat(F.lit(" About "), "r_name").alias("description"), "ballot_type",
        F.when(key == 2, F.array_append(some, F.get("names", F.lit(0)))).otherwise(some).alias("candidates"), (key * 3).alias("min_score"), F.lit(10).alias("max_score"), ((key - 1) * 50).alias("credit_budget"),
        (key != 4).alias("allow_abstention"), "r_name",
    )


def _unknown(ballots: DataFrame, candidates: DataFrame) -> DataFrame:
    """What ballots rank beyond the first three candidates."""
    return unknown_ids(ballots, candidates.filter("ord < 3"))


def election_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = F.when(F.col("min_score") == 3, 3.5).otherwise(F.col("min_score").cast("double"))
    told = elections.configuration_errors(_set_ups(spark, sf_dir).withColumn("min_score", halves))
    return told.select("r_name", "ballot_type", F.array_join("errors", " ").alias("errors"))


def election_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elections.payload(_set_ups(spark, sf_dir)).select("r_name", "ballot_type", "payload")


def ballot_type_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's ballot types, and how many elections of each are set up; types it does not know are left out."""
    counts = _set_ups(spark, sf_dir).groupBy("ballot_type").agg(F.count("*").alias("elections"))
    return elections.ballot_types(spark).join(counts, "ballot_type", "left").withColumn("elections", F.coalesce("elections", F.lit(0)).cast("long"))


def delegation_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delegation.resolved(delegation.latest(derive.delegations(spark, sf_dir)))


def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delegation.power(delegation_resolved(spark, sf_dir), derive.topic_voters(spark, sf_dir))


def delegation_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that lose half their weight each 700 days before 2001; no delegate takes more than twenty whole votes."""
    held = delegation.latest(derive.delegations(spark, sf_dir))
    age = F.datediff(F.lit("2001-01-01").cast("date"), F.col("given_at").cast("date"))
    accepted, kept = delegation.capped(held, 20 * delegation.UNIT, delegation.halved(age, 700))
    return accepted.unionByName(kept.select("topic", F.lit(None).cast("long").alias("delegate"), "voter", "units"))


def _weighted_counts(derived, method) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return method(*derive.weighted(derived, spark, sf_dir), weight="weight").counts.select("election_id", "candidate_id", "votes")

    return run


def weighted_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condorcet.pairwise_matrix(*derive.weighted(derive.ranked, spark, sf_dir), weight="weight")


def weighted_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(tally.approval(*derive.weighted(derive.approval, spark, sf_dir), weight="weight").header)


def weighted_runoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ballots, candidates = derive.weighted(derive.ranked, spark, sf_dir, by="c_mktsegment")
    return instant_runoff(ballots, candidates, weight="weight").more["round_counts"]


def jurisdiction_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = jurisdiction.weighted_voters(derive.located_voters(spark, sf_dir), derive.sites(spark, sf_dir), 1500.0)
    return told.withColumn("distance_km", F.round("distance_km", 6))


def jurisdiction_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An election at each site: customers near it vote for their market segment, with their weight there."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("voter"), F.col("c_mktsegment").alias("choice"))
    voters = derive.located_voters(spark, sf_dir).join(segments, "voter")
    ballots = stored(jurisdiction.weighted_choices(voters, derive.sites(spark, sf_dir), 1500.0), "jurisdiction-choices", tidy=True).select(F.col("site").cast("string").alias("election_id"), "choice", "weight")
    candidates = segments.select("choice").distinct().select(F.col("choice").alias("candidate_id"), F.lit(0).alias("ord"))
    candidates = ballots.select("election_id", F.lit(0).alias("ord")).distinct().join(candidates, "ord")
    return tally.plurality(ballots, candidates, weight="weight").counts.select("election_id", "candidate_id", "votes")


def median_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median.weighted_median(derive.values(spark, sf_dir), weight="weight")


def power_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(delegation.concentration(_power(spark, sf_dir).withColumn("power", F.col("own") + F.col("received"))))


def proposal_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.facets(listing.listed(*derive.filed(spark, sf_dir)))


def proposals_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest open proposals of a domain from before 1997."""
    return listing.page(listing.listed(*derive.filed(spark, sf_dir)), 50, (F.lit("1997-01-01").cast("timestamp"), 0), domain_id=3, status="O")


def proposal_verifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _forms(spark, sf_dir).withColumn("scope_geojson", F.when(F.col("id") % 3 != 0, F.col("scope_geojson")).otherwise("  "))
    return forms.select("id", listing.verifiability(F.col("metrics"), F.col("scope_geojson"), F.col("budget_items")).alias("score"))


def policy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(lifecycle.rates(derive.histories(spark, sf_dir)))


def _event_votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each week an election; an event is a ballot of its user, who has many in most weeks."""
    ballots, candidates = derive.single_choice(spark, sf_dir)
    users = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("voter_id"), F.col("user_id").cast("string").alias("user"))
    ballots = ballots.join(users, "voter_id").select("election_id", F.col("user").alias("voter_id"), "choice")
    return ballots.join(candidates.select("election_id", F.col("candidate_id").alias("choice")), ["election_id", "choice"]), candidates


def bounded_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = privacy.bounded(_event_votes(spark, sf_dir)[0], 3)
    return kept.groupBy("election_id", F.col("choice").alias("candidate_id")).agg(F.count("*").alias("votes"))


def private_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.private_tally(*_event_votes(spark, sf_dir), epsilon=1.0, most=3, seed="not a secret here", least=5)


def privacy_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as releases of that customer's data, a quarter of the budget of 2 or half of one each."""
    releases = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("data"), F.col("o_orderkey").alias("release"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 2 == 0, 0.5).otherwise(0.25).alias("epsilon"))
    return privacy.spent(releases, 2.0).drop("at")


def option_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand the options on the frontier of cost and size, and the first part as the status quo."""
    rows = derive.options(spark, sf_dir)
    first = rows.groupBy("brand").agg(F.min_by(F.struct("id", "cost", "benefit"), "id").alias("o")).select("brand", "o.*")
    return frontier.menu(rows, ["brand"], first)


def similar_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_groups(derive.draft_vectors(spark, sf_dir), threshold=0.95)


def queries() -> dict[str, Query]:
    return {
        "plurality_counts": _tallied(derive.single_choice, tally.plurality, "counts"),
        "plurality_winner": _tallied(derive.single_choice, tally.plurality, "header"),
        "approval_counts_rates": _tallied(derive.approval, tally.approval, "counts"),
        "approval_header": _tallied(derive.approval, tally.approval, "header"),
        "score_totals": _tallied(derive.score, tally.score, "counts"),
        "score_header": _tallied(derive.score, tally.score, "header"),
        "borda_totals": _tallied(derive.ranked, tally.borda, "counts"),
        "borda_header": _tallied(derive.ranked, tally.borda, "header"),
        "quadratic_totals": _tallied(derive.quadratic, tally.quadratic, "counts"),
        "quadratic_header": _tallied(derive.quadratic, tally.quadratic, "header"),
        "ballot_abstentions": _ballots(derive.single_choice, lambda b: b.groupBy("election_id").agg(F.count_if(B.is_single_abstention()).alias("abstentions"), F.count("*").alias("total_ballots"))),
        "ballot_validate_ranked": ballot_validate_ranked,
        "ballot_validate_score": _ballots(derive.score, lambda b: B.checked(b, B.score_error("scores", 1, 9), strict=False).select("election_id", "voter_id", "error")),
        "ballot_validate_quadratic": _ballots(derive.quadratic, lambda b: B.checked(b, B.quadratic_error("allocations", "credit_budget", allow_negative=False), strict=False).select("voter_id", "error")),
        "rank_lookup": _ballots(derive.ranked, lambda b: b.select("voter_id", B.rank_of("ranking", F.lit("3-MEDIUM")).alias("rank_of_medium"), B.choice_at("ranking", 2).alias("second_choice"), B.first_choice("ranking").alias("first_choice"), B.choice_at("ranking", 0).alias("choice_at_zero"))),
        "prefers_pairs": _ballots(derive.ranked, lambda b: b.withColumn("p", B.prefers("ranking", F.lit("1-URGENT"), F.lit("5-LOW"))).groupBy("election_id").agg(F.count_if("p").alias("urgent_over_low"), F.count_if(F.col("p").isNull()).alias("undecided"))),
        "pairwise_matrix": _pairwise(lambda m, c: m.select("election_id", "a", "b", "votes")),
        "pairwise_margins": _pairwise(lambda m, c: m),
        "condorcet_winner": _pairwise(lambda m, c: condorcet.condorcet_winner(condorcet.wins(m, c))),
        "victories_sorted": _pairwise(lambda m, c: condorcet.victories(m)),
        "ranked_pairs_locked": ranked_pairs_locked,
        "ranked_pairs_winner": ranked_pairs_winner,
        "irv_rounds": irv_rounds,
        "irv_round_counts": irv_round_counts,
        "irv_winner": irv_winner,
        "quadratic_ballot_costs": _ballots(derive.quadratic, lambda b: b.select("voter_id", B.total_cost("allocations").alias("total_cost"), B.credits_remaining("allocations", "credit_budget").alias("remaining"), F.round(B.credit_utilization("allocations", "credit_budget"), 9).alias("utilization"), B.candidates_in("allocations").alias("candidates"), B.max_votes_for_budget("credit_budget").alias("max_votes"))),
        "score_ballot_stats": _ballots(derive.score, lambda b: b.select("election_id", "voter_id", B.candidates_in("scores").alias("candidates"), B.total_points("scores").alias("total_points"), B.highest_score("scores").alias("highest"), B.lowest_score("scores").alias("lowest"), B.score_of("scores", F.lit("R")).alias("score_of_r"))),
        "nested_author_load": nested_author_load,
        "nested_children_load": nested_children_load,
        "programs_by_domain": programs_by_domain,
        "budget_rollup": lambda spark, sf_dir: proposals.budget_rollup(_items(spark, sf_dir)),
        "fk_orphans": fk_orphans,
        "unique_violations": lambda spark, sf_dir: proposals.repeated_keys(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority"),
        "proposal_validation": proposal_validation,
        "candidate_list_parse": lambda spark, sf_dir: table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(elections.candidate_list("text"), "|").alias("candidates")),
        "election_payload": election_payload,
        "election_configuration": election_configuration,
        "ballot_type_catalogue": ballot_type_catalogue,
        "approval_counts": _ballots(derive.approval, lambda b: b.select("election_id", *B.approval("voter_id", "approvals")).select("voter_id", B.approval_count().alias("n"))),
        "single_choices": _ballots(derive.single_choice, lambda b: b.select("election_id", *B.single_choice("voter_id", "choice"))),
        "quadratic_votes_for": _ballots(derive.quadratic, lambda b: b.select("voter_id", B.votes_for("allocations", F.lit("error")).alias("votes"), B.cost_of_votes(B.votes_for("allocations", F.lit("error"))).alias("cost"))),
        "ranked_unknown_ids": lambda spark, sf_dir: _unknown(*derive.ranked(spark, sf_dir)),
        "point_lookup": lambda spark, sf_dir: proposals.by_id(_store(spark, sf_dir)["app_user"], "id", 7),
        "programs_of_domain": lambda spark, sf_dir: proposals.programs_of(_store(spark, sf_dir)["program"], 2).select("id", "name"),
        "programs_with_domain": lambda spark, sf_dir: proposals.programs_with_domain(*(_store(spark, sf_dir)[n] for n in ("program", "domain"))).select("id", "name", F.col("domain.name").alias("domain")),
        "proposals_loaded": proposals_loaded,
        "proposals_listed": proposals_listed,
        **{f"form_rows_{n}": _form_rows(n) for n in ("proposal", "proposal_topic", "proposal_metric", "proposal_action", "proposal_budget_item")},
        "rows_inserted": rows_inserted,
        "rows_updated": rows_updated,
        "rows_deleted": rows_deleted,
        "delete_restricted": delete_restricted,
        "key_violations": key_violations,
        "input_coercions": input_coercions,
        "delegation_latest": lambda spark, sf_dir: delegation.latest(derive.delegations(spark, sf_dir)),
        "delegation_resolved": delegation_resolved,
        "delegation_power": _power,
        "delegation_capped": delegation_capped,
        "power_concentration": power_concentration,
        "weighted_plurality": _weighted_counts(derive.single_choice, tally.plurality),
        "weighted_approval": _weighted_counts(derive.approval, tally.approval),
        "weighted_approval_header": weighted_header,
        "weighted_score": _weighted_counts(derive.score, tally.score),
        "weighted_borda": _weighted_counts(derive.ranked, tally.borda),
        "weighted_quadratic": _weighted_counts(derive.quadratic, tally.quadratic),
        "weighted_matrix": weighted_matrix,
        "weighted_runoff": weighted_runoff,
        "jurisdiction_weights": jurisdiction_weights,
        "jurisdiction_tally": jurisdiction_tally,
        "median_choice": median_choice,
        "proposal_facets": proposal_facets,
        "proposals_page": proposals_page,
        "proposal_verifiability": proposal_verifiability,
        "status_intervals": lambda spark, sf_dir: lifecycle.intervals(derive.histories(spark, sf_dir)),
        "votes_by_status": lambda spark, sf_dir: lifecycle.turnout(derive.proposal_votes(spark, sf_dir), derive.histories(spark, sf_dir)),
        "policy_rates": policy_rates,
        "bounded_tally": bounded_tally,
        "private_tally": private_tally,
        "privacy_ledger": privacy_ledger,
        "option_menu": option_menu,
        "proposal_rules": proposal_rules,
        "similar_proposals": similar_proposals,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
