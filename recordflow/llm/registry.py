"""Queries of this package and the SQL each is checked against, in their own registry."""

from __future__ import annotations

from recordflow.plans.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

__all__ = ["ORACLE", "QUERIES", "query", "table"]


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
