"""Column functions: ballot predicates and measures, tiebreaks, validation rules."""
