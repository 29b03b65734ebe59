"""The registered queries, and the SQL each is checked against."""

from plumbline.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
