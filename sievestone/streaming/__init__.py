"""Structured Streaming forms of the ingest and index operators."""
