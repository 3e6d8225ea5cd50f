"""Structured Streaming ingest and windowed density."""
