"""Structured Streaming versions of bar building, ingest and episode state."""
