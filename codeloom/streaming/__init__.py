"""Structured Streaming jobs (R1–R5): alert ingest, enrichment, idempotent
retries, continuous file analysis, rolling 24 h activity."""
