"""Composed queries and their DuckDB counterparts."""
