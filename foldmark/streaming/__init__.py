"""Incremental ingest and running code statistics."""
