"""The proposal store's relations: nested loads, budget roll-ups, form validation and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.schemas import STATUSES


def children(child: DataFrame, key: str, fields: list[str], order: list[str], name: str) -> DataFrame:
    """One row per ``key`` with its child rows as a sorted array of structs."""
    entry = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("f"))
    return child.groupBy(F.col(key).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["f"]).alias(name))


def with_children(parent: DataFrame, key: str, nested: DataFrame, name: str) -> DataFrame:
    """``parent`` with the array ``name``, empty where it has no children. Each child table is gathered by itself, so several do not multiply."""
    kind = dict(nested.dtypes)[name]
    return parent.join(nested, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def with_parent(child: DataFrame, key: str, parent: DataFrame, parent_key: str, fields: list[str], name: str) -> DataFrame:
    """``child`` with its parent's ``fields`` as the struct ``name``, null where there is none."""
    row = parent.select(F.col(parent_key).alias("_key"), F.struct(*fields).alias(name))
    return child.join(row, F.col(key) == F.col("_key"), "left").drop("_key")


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def domains_with_programs(domains: DataFrame, programs: DataFrame) -> DataFrame:
    return with_children(domains, "id", children(programs, "domain_id", ["id", "name", "active"], ["name", "id"], "programs"), "programs")


def programs_with_domain(programs: DataFrame, domains: DataFrame) -> DataFrame:
    return with_parent(programs, "domain_id", domains, "id", ["id", "name", "active"], "domain")


def programs_of(programs: DataFrame, domain_id: str) -> DataFrame:
    return programs.filter(F.col("domain_id") == domain_id)


def proposals_loaded(proposals: DataFrame, users: DataFrame, topics: DataFrame, domains: DataFrame, programs: DataFrame, metrics: DataFrame | None = None, actions: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Proposals with author and topics (each with domain and program); with metrics, actions and budget items where given."""
    topics = with_parent(topics, "domain_id", domains, "id", ["id", "name", "active"], "domain")
    topics = with_parent(topics, "program_id", programs, "id", ["id", "domain_id", "name", "active"], "program")
    loaded = with_parent(proposals, "author_id", users, "id", ["id", "handle"], "author")
    loaded = with_children(loaded, "id", children(topics, "proposal_id", ["is_primary", "domain", "program"], ["domain_id", "program_id"], "topics"), "topics")
    if metrics is not None:
        fields = ["id", "name", "unit", "baseline_val", "baseline_year", "baseline_source", "target_val", "deadline"]
        loaded = with_children(loaded, "id", children(metrics, "proposal_id", fields, ["name", "id"], "metrics"), "metrics")
    if actions is not None:
        loaded = with_children(loaded, "id", children(actions, "proposal_id", ["id", "ordinal", "text"], ["ordinal", "id"], "actions"), "actions")
    if items is not None:
        fields = ["id", "item_name", "one_time_usd", "annual_usd", "confidence"]
        loaded = with_children(loaded, "id", children(items, "proposal_id", fields, ["item_name", "id"], "budget_items"), "budget_items")
    return loaded


def budget_rollup(items: DataFrame) -> DataFrame:
    """Sums of the budget items by proposal, as the proposal row holds them."""
    return items.groupBy("proposal_id").agg(F.sum("one_time_usd").cast("int").alias("budget_one_time_usd"), F.sum("annual_usd").cast("int").alias("budget_annual_usd"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose key names no parent; a null key refers to nothing and is fine."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def _blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.length(c), F.lit(0)) == 0


def _length(c: str, most: int) -> Column:
    return ~F.coalesce(F.length(c).between(1, most), F.lit(False))


def _any(c: str, broken) -> Column:
    return F.coalesce(F.exists(c, broken), F.lit(False))


def _uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def _size(c: str, low: int, high: int | None = None) -> Column:
    n = F.coalesce(F.size(c), F.lit(0))
    return (n < low) if high is None else ~n.between(low, high)


def form_errors(forms: DataFrame) -> DataFrame:
    """Proposal forms with ``errors``: the names of the rules each breaks, in the form's order.

    Fields: title, summary, problem_plain, actions[{text}], metrics[{name, unit, baseline_val, target_val, deadline}],
    population_estimate, topics[{domain_id, program_id, is_primary}], budget_items[{item_name, one_time_usd,
    annual_usd, confidence}], needs_new_authority, retention_days, author_id.
    """
    rules = [
        ("title_length", _length("title", 60)),
        ("summary_length", _length("summary", 280)),
        ("problem_length", _length("problem_plain", 1500)),
        ("actions_count", _size("actions", 3, 7)),
        ("action_text", _any("actions", lambda a: _blank(a["text"]))),
        ("metrics_count", _size("metrics", 1)),
        ("metric_fields", _any("metrics", lambda m: _blank(m["name"]) | _blank(m["unit"]) | _blank(m["baseline_val"]) | _blank(m["target_val"]) | _blank(m["deadline"]))),
        ("population_positive", F.coalesce(F.col("population_estimate") <= 0, F.lit(False))),
        ("topics_count", _size("topics", 1)),
        ("topic_ids", _any("topics", lambda t: ~_uuid(t["domain_id"]) | (t["program_id"].isNotNull() & ~_uuid(t["program_id"])) | t["is_primary"].isNull())),
        ("budget_items_count", _size("budget_items", 1)),
        ("budget_item_fields", _any("budget_items", lambda b: _blank(b["item_name"]) | ~F.coalesce((b["one_time_usd"] >= 0) & (b["annual_usd"] >= 0) & b["confidence"].between(0, 1), F.lit(False)))),
        ("needs_new_authority", F.col("needs_new_authority").isNull()),
        ("retention_positive", F.coalesce(F.col("retention_days") <= 0, F.lit(False))),
        ("author_id", ~_uuid(F.col("author_id"))),
    ]
    return forms.withColumn("errors", F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules])))


def parsed_int(text: str | Column) -> Column:
    """The whole number that a form field begins with, null where there is none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def int_or_zero(text: str | Column) -> Column:
    return F.coalesce(parsed_int(text), F.lit(0))


def confidence_or_half(text: str | Column) -> Column:
    """The number that a form field begins with; one half where there is none, or zero, as the form has it."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
    return F.when(number != 0, number).otherwise(F.lit(0.5))


#: What a form may leave out, beside its author, texts, lists and whether it needs new authority.
_OPTIONAL = {
    "implementing_org": "string", "scope_geojson": "string", "population_estimate": "int", "population_source": "string", "funding_notes": "string", "legal_citation": "string",
    "equity_beneficiaries": "string", "equity_cost_bearers": "string", "safeguards_rollback_trigger": "string", "safeguards_rollback_steps": "string", "sunset_date": "string",
    "privacy_notes": "string", "retention_days": "int",
}


def form_rows(forms: DataFrame) -> dict[str, DataFrame]:
    """The table rows that checked forms (with an ``id``) are stored as: the proposal, a draft with summed budgets, and its children.

    Fields that a form may leave out, and a metric's baseline_year and baseline_source, are null where there is no such
    column. An empty sunset date is null; actions are numbered from 1 in their order; ids of children follow from the
    proposal's.
    """
    for name, kind in _OPTIONAL.items():
        if name not in forms.columns:
            forms = forms.withColumn(name, F.lit(None).cast(kind))
    total = lambda field: F.aggregate("budget_items", F.lit(0).cast("long"), lambda s, b: s + b[field].cast("long")).cast("int")
    key = F.col("id").alias("proposal_id")
    own = lambda table, n: F.sha2(F.concat_ws(":", F.lit(table), F.col("proposal_id"), n.cast("string")), 256)
    proposal = forms.select(
        "id", "author_id", F.lit("draft").alias("status"), "title", "summary", "problem_plain", "implementing_org", "scope_geojson", "population_estimate", "population_source",
        total("one_time_usd").alias("budget_one_time_usd"), total("annual_usd").alias("budget_annual_usd"), "funding_notes", "legal_citation", "needs_new_authority", "equity_beneficiaries",
        "equity_cost_bearers", "safeguards_rollback_trigger", "safeguards_rollback_steps", F.nullif(F.col("sunset_date").cast("string"), F.lit("")).cast("date").alias("sunset_date"), "privacy_notes",
        "retention_days",
    )
    topics = forms.select(key, F.explode("topics").alias("t")).select("proposal_id", "t.domain_id", "t.program_id", "t.is_primary")
    actions = forms.select(key, F.posexplode("actions").alias("n", "a")).select(own("action", F.col("n")).alias("id"), "proposal_id", (F.col("n") + 1).alias("ordinal"), "a.text")
    given = {f.name for f in forms.schema["metrics"].dataType.elementType.fields}
    optional = [(F.col(f"m.{c}") if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in (("baseline_year", "int"), ("baseline_source", "string"))]
    metrics = forms.select(key, F.posexplode("metrics").alias("n", "m")).select(
        own("metric", F.col("n")).alias("id"), "proposal_id", "m.name", "m.unit", F.col("m.baseline_val").cast("decimal(12,4)").alias("baseline_val"), *optional,
        F.col("m.target_val").cast("decimal(12,4)").alias("target_val"), F.col("m.deadline").cast("date").alias("deadline"),
    )
    items = forms.select(key, F.posexplode("budget_items").alias("n", "b")).select(own("item", F.col("n")).alias("id"), "proposal_id", "b.item_name", "b.one_time_usd", "b.annual_usd", F.col("b.confidence").cast("decimal(3,2)").alias("confidence"))
    return {"proposal": proposal, "proposal_topic": topics, "proposal_action": actions, "proposal_metric": metrics, "proposal_budget_item": items}


def status_errors(proposals: DataFrame) -> DataFrame:
    return proposals.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))
