"""Registry of the queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows on the same tables."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    """An amount as whole cents, so that sums do not depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def words(column: str) -> Column:
    """Words between blanks and line breaks; one-character splits take Java's fast path."""
    return F.array_remove(F.split(F.replace(F.col(column), F.lit("\n"), F.lit(" ")), " "), "")
