"""Registered queries: one per operator, each with SQL that gives the same rows."""

from queries.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
