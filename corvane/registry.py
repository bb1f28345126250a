"""Registered queries of the retrieval engine."""

from corvane.plans.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
