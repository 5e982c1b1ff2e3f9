"""Scans, payload flattening, audited ingest and table writers."""
