"""Connected components of a large edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.storage import cut_counted, scratch_path


def _written(df: DataFrame, **counts) -> tuple[DataFrame, dict[str, int]]:
    return cut_counted(df, scratch_path(df.sparkSession, "components"), **counts)


def _least(down: DataFrame) -> tuple[DataFrame, int]:
    """``(u, m)``, the least neighbour of each ``u``, and how many these are."""
    table, seen = _written(down.groupBy("u").agg(F.min("v").alias("m")))
    return table, seen["n"]


def _small_star(down: DataFrame) -> tuple[DataFrame, int]:
    """Every ``u`` and its other neighbours beside its least one, once each."""
    least, _ = _least(down)
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    table, seen = _written(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    return table, seen["n"]


def _large_star(table: DataFrame, least: DataFrame) -> tuple[DataFrame, int]:
    """Every ``u`` beside the least neighbours of its own ones, and how many of these are new to it.

    All neighbours ``v`` are less than ``u``, so a ``v`` without a row of its own is the least of its neighbours.
    """
    joined = table.join(least.toDF("v", "m"), "v", "left")
    raised, seen = _written(joined.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("new")), new=F.count_if("new"))
    return raised.select("u", "v"), seen["new"]


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` for every node ``u`` of ``edges(u, v)`` that is not the least of its component ``v``.

    Each round is a few joins on nodes, whose rows are halved where Spark finds a skewed one. What several
    steps read is written once, and the counts that end the rounds come from those writes, so that a round is few
    tasks for the driver; the number of rounds grows with the logarithm of the longest path.
    """
    apart = edges.where(F.col("u") != F.col("v"))
    table, n = _small_star(apart.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    forest = False
    while n:
        if forest:
            least = table
        else:
            least, heads = _least(table)
            # With one neighbour each, nodes point upwards and need no small star any more.
            forest = heads == n
        raised, new = _large_star(table, least)
        if forest and not new:
            return table
        table, n = (raised, n) if forest else _small_star(raised)
    return table
