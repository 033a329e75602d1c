"""Schemas of the ballot and proposal frames, as DDL."""

from pyspark.sql.types import StructField, StructType

CANDIDATES = "election_id STRING, candidate_id STRING, name STRING, ord INT"
ELECTIONS = "election_id STRING"
SINGLE_CHOICE = "election_id STRING, voter_id STRING, choice STRING"
APPROVAL = "election_id STRING, voter_id STRING, approvals ARRAY<STRING>"
RANKED = "election_id STRING, voter_id STRING, ranking ARRAY<STRING>"
SCORE = "election_id STRING, voter_id STRING, scores MAP<STRING,INT>"
QUADRATIC = "election_id STRING, voter_id STRING, allocations MAP<STRING,INT>, credit_budget INT"

APP_USER = "id STRING, handle STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
DOMAIN = "id STRING, name STRING, active BOOLEAN"
PROGRAM = "id STRING, domain_id STRING, name STRING, active BOOLEAN"
PROPOSAL = (
    "id STRING, author_id STRING, status STRING, title STRING, summary STRING, problem_plain STRING, implementing_org STRING, scope_geojson STRING, "
    "population_estimate INT, population_source STRING, budget_one_time_usd INT, budget_annual_usd INT, funding_notes STRING, legal_citation STRING, "
    "needs_new_authority BOOLEAN, equity_beneficiaries STRING, equity_cost_bearers STRING, safeguards_rollback_trigger STRING, "
    "safeguards_rollback_steps STRING, sunset_date DATE, privacy_notes STRING, retention_days INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
PROPOSAL_TOPIC = "proposal_id STRING, domain_id STRING, program_id STRING, is_primary BOOLEAN"
PROPOSAL_METRIC = "id STRING, proposal_id STRING, name STRING, unit STRING, baseline_val DECIMAL(12,4), baseline_year INT, baseline_source STRING, target_val DECIMAL(12,4), deadline DATE"
PROPOSAL_ACTION = "id STRING, proposal_id STRING, ordinal INT, text STRING"
PROPOSAL_BUDGET_ITEM = "id STRING, proposal_id STRING, item_name STRING, one_time_usd INT, annual_usd INT, confidence DECIMAL(3,2)"

TABLES = {
    "app_user": APP_USER, "domain": DOMAIN, "program": PROGRAM, "proposal": PROPOSAL, "proposal_topic": PROPOSAL_TOPIC,
    "proposal_metric": PROPOSAL_METRIC, "proposal_action": PROPOSAL_ACTION, "proposal_budget_item": PROPOSAL_BUDGET_ITEM,
}
STATUSES = ("draft", "active", "passed", "failed", "archived")
#: (child, column, parent, what deleting the parent does)
FOREIGN_KEYS = (
    ("program", "domain_id", "domain", "restrict"),
    ("proposal", "author_id", "app_user", "restrict"),
    ("proposal_topic", "proposal_id", "proposal", "cascade"),
    ("proposal_topic", "domain_id", "domain", "restrict"),
    ("proposal_topic", "program_id", "program", "restrict"),
    ("proposal_metric", "proposal_id", "proposal", "cascade"),
    ("proposal_action", "proposal_id", "proposal", "cascade"),
    ("proposal_budget_item", "proposal_id", "proposal", "cascade"),
)
#: The unique keys beside ids that the store holds.
UNIQUE_KEYS = (("app_user", ("handle",)), ("domain", ("name",)))
#: Unique keys that are declared for the model but that stored tables need not meet.
DECLARED_KEYS = (("proposal_topic", ("proposal_id", "domain_id")), ("proposal_action", ("proposal_id", "ordinal")), ("program", ("domain_id", "name")))


def fields(name: str) -> list[StructField]:
    return StructType.fromDDL(TABLES[name]).fields


def create_table(name: str, using: str = "parquet") -> str:
    """The statement that makes the table ``name`` in Spark's catalogue."""
    return f"CREATE TABLE IF NOT EXISTS {name} ({TABLES[name]}) USING {using}"
