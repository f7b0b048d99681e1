"""Structured Streaming forms of ingest, state and publication."""
