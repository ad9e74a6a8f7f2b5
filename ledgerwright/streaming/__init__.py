"""Structured Streaming forms of ingest, vendor statistics and triage."""
