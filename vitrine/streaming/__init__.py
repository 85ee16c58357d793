"""Structured Streaming ingest and incremental marts."""
