"""Incremental ingest and mining."""
