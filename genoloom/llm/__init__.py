"""Operators for large-scale training-data preparation (no other part of the library imports this)."""
