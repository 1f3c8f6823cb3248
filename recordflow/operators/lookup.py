"""Layered settings: a value of a record's own scope, else of its parent's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.storage import sized


def layered_lookup(
    records: DataFrame, own: DataFrame, own_key: str, fallback: DataFrame, fallback_key: str, value: str
) -> DataFrame:
    """Add ``value``: from ``own`` by ``own_key``, else from ``fallback`` by ``fallback_key``, else NULL.

    Each table holds one row per key and is computed once. Tables measured as small are broadcast, so that a key on
    a third of the records moves nothing; larger ones join by shuffle, where AQE splits it.
    """
    first = own.select(F.col(own_key), F.struct(F.col(value)).alias("__own"))
    second = fallback.select(F.col(fallback_key), F.col(value).alias("__fallback"))
    joined = records.join(sized(first, "own"), own_key, "left")
    joined = joined.join(sized(second, "fallback"), fallback_key, "left")
    found = F.when(F.col("__own").isNotNull(), F.col(f"__own.`{value}`")).otherwise(F.col("__fallback"))
    return joined.select(*[F.col(f"`{c}`") for c in records.columns if c != value], found.alias(value))
