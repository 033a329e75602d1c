"""Structured Streaming forms of the mergeable tallies."""
