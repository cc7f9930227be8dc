"""Operators put together: the nightly ingest and the report."""
