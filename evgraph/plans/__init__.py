"""Registered queries: QUERIES by name, and the SQL of each."""

from evgraph.plans import analysis, evidence, ingest  # noqa: F401
from evgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
