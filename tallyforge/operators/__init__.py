"""Operators on ballot, candidate and proposal frames."""
