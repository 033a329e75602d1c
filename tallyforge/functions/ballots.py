"""Ballot columns: what the ballot constructors, predicates and measures of each ballot type are as expressions.

Ballot columns are ``choice`` string, ``approvals`` and ``ranking`` array<string>, ``scores`` and ``allocations``
map<string,int> with ``credit_budget`` int. A null array or map is an abstention, as an empty one is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MIN_SCORE, MAX_SCORE, DEFAULT_CREDIT_BUDGET = 0, 10, 100
_STRINGS, _COUNTS = "array<string>", "map<string,int>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _list(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.array().cast(_STRINGS))


def _map(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.create_map().cast(_COUNTS))


def _sum(values: Column, term: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + term(v.cast("long")))


# constructors


def single_choice(voter_id: str | Column, choice: str | Column) -> list[Column]:
    """No choice is an abstention; the empty string is a choice."""
    return [_col(voter_id).alias("voter_id"), _col(choice).alias("choice")]


def approval(voter_id: str | Column, approvals: str | Column) -> list[Column]:
    return [_col(voter_id).alias("voter_id"), F.array_distinct(_list(approvals)).alias("approvals")]


def ranked(voter_id: str | Column, ranking: str | Column) -> list[Column]:
    return [_col(voter_id).alias("voter_id"), _list(ranking).alias("ranking")]


def score(voter_id: str | Column, scores: str | Column) -> list[Column]:
    return [_col(voter_id).alias("voter_id"), _map(scores).alias("scores")]


def quadratic(voter_id: str | Column, allocations: str | Column, credit_budget: str | Column | None = None) -> list[Column]:
    budget = F.lit(DEFAULT_CREDIT_BUDGET) if credit_budget is None else F.coalesce(_col(credit_budget), F.lit(DEFAULT_CREDIT_BUDGET))
    return [_col(voter_id).alias("voter_id"), _map(allocations).alias("allocations"), budget.alias("credit_budget")]


# abstention and size


def is_single_abstention(choice: str | Column = "choice") -> Column:
    return _col(choice).isNull()


def is_list_abstention(values: str | Column) -> Column:
    return F.size(_list(values)) == 0


def is_map_abstention(values: str | Column) -> Column:
    return F.size(_map(values)) == 0


def approval_count(approvals: str | Column = "approvals") -> Column:
    return F.size(F.array_distinct(_list(approvals)))


def candidates_in(values: str | Column) -> Column:
    """How many candidates a score or quadratic ballot names."""
    return F.size(_map(values))


# ranked ballots


def rank_of(ranking: str | Column, candidate: str | Column) -> Column:
    """The 1-based rank, null where the candidate is not ranked."""
    return F.nullif(F.array_position(_list(ranking), _col(candidate)), F.lit(0).cast("long"))


def choice_at(ranking: str | Column, rank: int | Column) -> Column:
    """The id at a 1-based rank; null for a rank below 1 or beyond the last."""
    at = F.lit(rank) if isinstance(rank, int) else rank
    return F.get(_list(ranking), at - 1)


def first_choice(ranking: str | Column) -> Column:
    return choice_at(ranking, 1)


def prefers(ranking: str | Column, a: str | Column, b: str | Column) -> Column:
    """Whether a is ranked above b: null if either is unranked, false for one candidate against itself."""
    return rank_of(ranking, a) < rank_of(ranking, b)


# score ballots


def score_of(scores: str | Column, candidate: str | Column) -> Column:
    return F.coalesce(_map(scores)[_col(candidate)], F.lit(0))


def total_points(scores: str | Column) -> Column:
    return _sum(F.map_values(_map(scores)))


def highest_score(scores: str | Column) -> Column:
    return F.array_max(F.map_values(_map(scores)))


def lowest_score(scores: str | Column) -> Column:
    return F.array_min(F.map_values(_map(scores)))


# quadratic ballots


def cost_of_votes(votes: str | Column) -> Column:
    votes = _col(votes).cast("long")
    return votes * votes


def total_cost(allocations: str | Column) -> Column:
    """Credits spent, those on unknown candidates included."""
    return _sum(F.map_values(_map(allocations)), lambda v: v * v)


def credits_remaining(allocations: str | Column, credit_budget: str | Column) -> Column:
    return _col(credit_budget).cast("long") - total_cost(allocations)


def votes_for(allocations: str | Column, candidate: str | Column) -> Column:
    return F.coalesce(_map(allocations)[_col(candidate)], F.lit(0))


def credit_utilization(allocations: str | Column, credit_budget: str | Column) -> Column:
    budget = _col(credit_budget)
    return F.when(budget == 0, F.lit(0.0)).otherwise(total_cost(allocations) / budget)


def max_votes_for_budget(budget: str | Column) -> Column:
    """The integer square root; an error for a negative budget."""
    b = _col(budget).cast("long")
    root = F.floor(F.sqrt(F.greatest(b, F.lit(0)).cast("double"))).cast("long")
    root = root - F.when(root * root > b, 1).otherwise(0)
    root = root + F.when((root + 1) * (root + 1) <= b, 1).otherwise(0)
    return F.when(b < 0, F.raise_error(F.lit("the budget is negative")).cast("long")).otherwise(root)


# validation: the first rule a ballot breaks, null if none


def ranked_error(ranking: str | Column, candidates: str | Column | None = None) -> Column:
    """'duplicates'; with the election's candidates also 'missing_and_unknown', 'incomplete' or 'unknown'.

    Without candidates an empty ranking is an abstention; with them it is incomplete. A null one always abstains.
    """
    r = _list(ranking)
    rules = F.when(F.size(r) != F.size(F.array_distinct(r)), "duplicates")
    if candidates is not None:
        missing, unknown = F.size(F.array_except(_list(candidates), r)) > 0, F.size(F.array_except(r, _list(candidates))) > 0
        rules = rules.when(missing & unknown, "missing_and_unknown").when(missing, "incomplete").when(unknown, "unknown")
    return F.when(_col(ranking).isNull(), F.lit(None).cast("string")).otherwise(rules)


def score_error(scores: str | Column, low: int = MIN_SCORE, high: int = MAX_SCORE) -> Column:
    """'out_of_range' if a score is missing, below ``low`` or above ``high``."""
    values = F.map_values(_map(scores))
    return F.when(F.exists(values, lambda v: v.isNull() | (v < low) | (v > high)), "out_of_range")


def quadratic_error(allocations: str | Column, credit_budget: str | Column, allow_negative: bool = True) -> Column:
    """'not_integer', 'zero', 'negative' (unless allowed) or 'over_budget'; spending all of the budget is fine."""
    values = F.map_values(_map(allocations))
    rules = F.when(F.exists(values, lambda v: v.isNull()), "not_integer").when(F.exists(values, lambda v: v == 0), "zero")
    if not allow_negative:
        rules = rules.when(F.exists(values, lambda v: v < 0), "negative")
    return rules.when(total_cost(allocations) > _col(credit_budget), "over_budget")


def checked(ballots: DataFrame, error: Column, strict: bool = True) -> DataFrame:
    """``ballots`` with the rule broken in ``error`` (permissive) or failing at the first such ballot (strict)."""
    if not strict:
        return ballots.withColumn("error", error)
    failed = F.raise_error(F.concat(F.lit("invalid ballot: "), error))
    return ballots.filter(F.when(error.isNotNull(), failed.cast("boolean")).otherwise(F.lit(True)))
