"""Set steps: one result for a whole record set, and what they do to the set.

A set result is a one-row DataFrame. It reaches other rows as a scalar subquery, which
Spark runs once, checks to be one row and inlines as a literal: no join, no exchange of
the records.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.operators.records import KEY, check_keys
from recordflow.operators.steps import did_run, has_run, is_skipped
from recordflow.storage import cut, sized


def set_step(records: DataFrame, aggs: Mapping[str, Column], condition: Column | None = None) -> DataFrame:
    """One-row result of aggregates over the whole set.

    ``condition`` is an aggregate too; where it is false the step does not run and its labels
    are NULL.
    """
    if condition is not None:
        open_ = F.coalesce(condition, F.lit(True))
        aggs = {label: F.when(open_, value) for label, value in aggs.items()}
    return records.agg(*[value.alias(label) for label, value in aggs.items()])


def set_value(set_result: DataFrame) -> Column:
    """The one row of a set result as a struct column usable in any other query."""
    return set_result.select(F.struct(*[F.col(f"`{c}`") for c in set_result.columns])).scalar()


def with_set_result(records: DataFrame, name: str, set_result: DataFrame) -> DataFrame:
    """Give the set result to every record under ``name``."""
    return records.withColumn(name, set_value(set_result))


def set_chain(
    records: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]
) -> DataFrame:
    """Set steps in order; each sees the earlier results as struct columns of every record.

    Returns one row with one struct per step.
    """
    view, done = records, {}
    for name, step in steps:
        result = step(view)
        done[name] = set_value(result)
        view = view.withColumn(name, done[name])
    return records.sparkSession.range(1).select(*[value.alias(name) for name, value in done.items()])


def pass_through(records: DataFrame) -> DataFrame:
    """Set step that leaves the records alone."""
    return records


def attach(records: DataFrame, name: str, out: DataFrame, skip: object = False) -> DataFrame:
    """Store the labels of ``out`` under ``name``; ids of ``out`` are the new set.

    Ids missing from ``out`` are dropped and ids new in ``out`` are added. An update has one row for each id: a
    repeated one fails, found along the join's own partitioning. NULL ids are left to :func:`check_keys`.
    """
    if is_skipped(skip):
        return records
    labels = [F.col(f"`{c}`") for c in out.columns if c != KEY]
    update = out.select(KEY, F.struct(*labels).alias(name))
    repeats = F.count(KEY).over(Window.partitionBy(KEY).orderBy(KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    problem = F.raise_error(F.concat(F.lit("repeated id in an update: "), KEY)).cast("boolean")
    update = update.withColumn("__n", repeats).where(F.when(F.col("__n") <= 1, F.lit(True)).otherwise(problem)).drop("__n")
    return update.join(records.drop(name), KEY, "left").select(
        KEY, *[F.col(f"`{c}`") for c in records.columns if c not in (KEY, name)], F.col(f"`{name}`")
    )


def keep_ids(records: DataFrame, ids: DataFrame, measured: bool = False) -> DataFrame:
    """Keep the records named in ``ids``; unknown ids are ignored.

    Ids are made distinct first: repeats of one id are folded before the shuffle, and the
    distinct's partitioning serves the join. ``measured`` writes the distinct ids first, so that
    wide records are not shuffled when the ids turn out to be few.
    """
    wanted = ids.select(KEY).distinct()
    return records.join(sized(wanted, "kept") if measured else wanted, KEY, "left_semi")


def keep_where(records: DataFrame, predicate: Column | Callable[[pd.DataFrame], pd.Series], inputs=()) -> DataFrame:
    """Keep the records where a predicate holds.

    A Column stays in the JVM; a pandas function gets batches of the ``inputs`` columns.
    """
    if isinstance(predicate, Column):
        return records.where(predicate)

    @F.pandas_udf(T.BooleanType())
    def call(batch: pd.DataFrame) -> pd.Series:
        return predicate(batch).astype("boolean")

    return records.where(call(F.struct(*[F.col(c) for c in inputs])))


def remap(records: DataFrame, fn: Callable[[DataFrame], DataFrame], check: bool = False) -> DataFrame:
    """Replace the whole set by ``fn(records)``; old labels are gone.

    ``check`` verifies the new keys, at the price of one aggregate job.
    """
    new = fn(records)
    if KEY not in new.columns:
        raise ValueError(f"a remapped set needs a {KEY} column")
    return check_keys(new, mode="fail")[0] if check else new


def gather(records: DataFrame, step: str, label: str, only_ran: bool = False) -> DataFrame:
    """``(record_id, label)`` of one step over all records that have it, as a table."""
    present = did_run(records, step) if only_ran else has_run(records, step)
    return records.where(present).select(KEY, F.col(f"`{step}`.`{label}`").alias(label))


def concat_content(records: DataFrame, items: Column, separator: str = ":") -> DataFrame:
    """All records' items as one collection: ``(content_id, record_id, item_no, item)``.

    ``items`` is an array; item numbers start at 0 and ids are ``record_id:item_no``.
    """
    exploded = records.select(KEY, F.posexplode(items).alias("item_no", "item"))
    content_id = F.concat_ws(separator, KEY, F.col("item_no").cast("string"))
    return exploded.select(content_id.alias("content_id"), KEY, F.col("item_no").cast("long").alias("item_no"), "item")


def rollup_content(content: DataFrame, by: str | Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """Number of sequences and their total length by record."""
    keys = [by] if isinstance(by, str) else list(by)
    return content.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length(seq)).cast("long").alias("total_length")
    )


def set_manifest(records: DataFrame, value: Column) -> DataFrame:
    """``id<TAB>value`` line of every record, ready for ``write.text``."""
    return records.select(F.concat_ws("\t", F.col(KEY), value.cast("string")).alias("value"))


def take_while(records: DataFrame, order: str | Column, predicate: Column) -> DataFrame:
    """Records before the first one, in ``order``, where the predicate fails.

    The order key must be unique. No global sort: one aggregate job finds the first failing
    key, a single value, and the result is a filter on a constant, which the scan uses to skip
    what lies behind it. A NULL predicate fails. Records without an order key come last, in no order among
    themselves: they stay if the predicate fails nowhere.
    """
    key = F.col(order) if isinstance(order, str) else order
    failing = records.where(~predicate | predicate.isNull())
    found = failing.agg(F.min(key).alias("stop"), F.count(F.lit(1)).alias("n")).first()
    if found["stop"] is not None:
        return records.where(key < F.lit(found["stop"]))
    return records.where(key.isNotNull()) if found["n"] else records


def every_nth(records: DataFrame, n: int, offset: int = 0, order: str | Sequence[str] = KEY) -> DataFrame:
    """Records at positions ``offset, offset + n, ...`` of the whole ordered set.

    Only order keys and ids are sorted by range and numbered; one count for each partition is
    summed up to offsets, so no task ever sees the whole set. The records are then filtered
    by the kept ids, where they are while those are measured as few.
    """
    if n < 1 or not 0 <= offset < n:
        raise ValueError("need n >= 1 and 0 <= offset < n")
    keys = [order] if isinstance(order, str) else list(order)
    sort_keys = keys if KEY in keys else keys + [KEY]
    numbered = records.select(*dict.fromkeys([KEY, *sort_keys])).sort(*sort_keys).withColumn("__row", F.monotonically_increasing_id())
    # Layout of the row number, partition above bit 33, row below it.
    part = F.shiftright("__row", 33)
    table = cut(numbered, "every_nth").withColumns(
        {"__part": part, "__pos": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = table.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions, so the
    # unpartitioned window and the broadcast stay small whatever the set holds.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    placed = table.join(F.broadcast(starts), "__part")
    position = F.col("__start") + F.col("__pos")
    kept = placed.where(F.pmod(position, F.lit(n)) == offset).select(KEY)
    return records.join(sized(kept, "kept"), KEY, "left_semi").select(*[F.col(f"`{c}`") for c in records.columns])
