"""Queries over the test tables, each with the SQL that it has to agree with."""

from querybook import aggregates, decisions, ingest, pulls, sources  # noqa: F401
from querybook.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
