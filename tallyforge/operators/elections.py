"""Election set-up: candidate lists from text, configuration rules and the payload document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Ballot types with their labels and descriptions, and what each broken rule says.
BALLOT_TYPES = {
    "single_choice": ("Single Choice", "Each voter may pick exactly one candidate or abstain."),
    "approval": ("Approval", "Each voter may approve zero or more candidates."),
    "ranked_choice": ("Ranked Choice", "Each voter submits a strict, full ranking of all candidates."),
    "score": ("Score", "Each voter assigns integer scores to candidates on a fixed range."),
    "quadratic": ("Quadratic", "Each voter allocates votes under a quadratic credit budget."),
}
MESSAGES = {
    "title": "Election title is required.",
    "two_candidates": "At least two candidates are required.",
    "unique_candidates": "Candidate names must be unique.",
    "three_candidates": "Ranked choice works best with at least three candidates.",
    "integer_bounds": "Score bounds must be integers.",
    "ordered_bounds": "Score minimum must be less than score maximum.",
    "budget": "Quadratic credit budget must be a positive integer.",
}
_SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def trimmed(text: str | Column) -> Column:
    """Without white space of any script at either end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, f"^{_SPACES}|{_SPACES}$", "")


def candidate_list(raw: str | Column) -> Column:
    """One candidate per line, trimmed, blank lines left out."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), trimmed), lambda c: c != "")


def ballot_types(spark) -> DataFrame:
    """(ballot_type, label, description) of the catalogue."""
    return spark.createDataFrame([(k, *v) for k, v in BALLOT_TYPES.items()], "ballot_type string, label string, description string")


def _integer(value: str) -> Column:
    """Whether a number of any type is whole; a missing one is not."""
    number = F.col(value).cast("double")
    return F.coalesce((number == F.floor(number)) & ~F.isnan(number), F.lit(False))


def _or(elections: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in elections.columns else default


def configuration_errors(elections: DataFrame) -> DataFrame:
    """``elections`` (title, ballot_type, candidates, min_score, max_score, credit_budget) with ``errors`` array<string>.

    The messages of all rules broken, in the order of ``MESSAGES``; a ballot type that is not in the catalogue is named last.
    """
    names, kind = F.col("candidates"), F.col("ballot_type")
    scored, funded = kind == "score", kind == "quadratic"
    rules = [
        ("title", F.coalesce(trimmed("title"), F.lit("")) == ""),
        ("two_candidates", F.coalesce(F.size(names), F.lit(0)) < 2),
        ("unique_candidates", F.size(names) != F.size(F.array_distinct(names))),
        ("three_candidates", (kind == "ranked_choice") & (F.coalesce(F.size(names), F.lit(0)) < 3)),
        ("integer_bounds", scored & ~(_integer("min_score") & _integer("max_score"))),
        ("ordered_bounds", scored & F.coalesce(F.col("min_score") >= F.col("max_score"), F.lit(False))),
        ("budget", funded & ~(_integer("credit_budget") & F.coalesce(F.col("credit_budget") > 0, F.lit(False)))),
    ]
    unknown = F.when(~F.coalesce(kind.isin(*BALLOT_TYPES), F.lit(False)), F.concat(F.lit("Unknown ballot type: "), F.coalesce(kind, F.lit("none")), F.lit(".")))
    return elections.withColumn("errors", F.array_compact(F.array(*[F.when(broken, MESSAGES[name]) for name, broken in rules], unknown)))


def payload(elections: DataFrame) -> DataFrame:
    """``elections`` with ``payload``: the election as a JSON document whose constraints are those of its ballot type.

    allow_abstention and allow_negative_votes are true where there is no such column; the payload of an unknown ballot
    type is null. Title and description are trimmed, missing ones empty.
    """
    abstain = _or(elections, "allow_abstention", F.lit(True)).alias("allowAbstention")
    constraints = {
        "single_choice": [F.lit(1).alias("maxSelections")],
        "approval": [F.lit(0).alias("minApprovals"), F.size("candidates").alias("maxApprovals")],
        "ranked_choice": [F.lit(True).alias("requiresFullRanking"), F.lit(True).alias("strictOrdering")],
        "score": [F.struct(F.col("min_score").alias("min"), F.col("max_score").alias("max")).alias("scoreRange"), F.lit(True).alias("integerOnly"), F.lit(True).alias("allowPartialScoring")],
        "quadratic": [F.col("credit_budget").alias("creditBudget"), F.lit("votes^2").alias("costFunction"), _or(elections, "allow_negative_votes", F.lit(True)).alias("allowNegativeVotes")],
    }
    told = [F.coalesce(trimmed(c), F.lit("")).alias(c) for c in ("title", "description")]
    document = F.lit(None).cast("string")
    for kind, own in constraints.items():
        whole = F.struct(F.struct(*told).alias("election"), F.col("ballot_type").alias("ballotType"), F.col("candidates"), F.struct(*own, abstain).alias("constraints"))
        document = F.when(F.col("ballot_type") == kind, F.to_json(whole)).otherwise(document)
    return elections.withColumn("payload", document)
