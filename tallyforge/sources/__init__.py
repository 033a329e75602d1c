"""Schemas, stored tables and frames derived from other tables."""
