"""Structured Streaming jobs: ingest and running counters."""
