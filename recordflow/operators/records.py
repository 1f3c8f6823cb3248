"""Record sets: one row per ``record_id STRING``, one column per label or step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.storage import broadcast_if_small, cut

KEY = "record_id"


class InvalidKeys(ValueError):
    """Keys that are missing, hold a space, or occur more than once."""


class MissingLabel(ValueError):
    """A requested label or step that the record set does not have."""


def keyed_records(
    df: DataFrame, key: str | Column, labels: Sequence[str] | Mapping[str, Column] | None = None
) -> DataFrame:
    """Record set of any DataFrame: ``key`` as text, then the labels."""
    key_col = F.col(key) if isinstance(key, str) else key
    if labels is None:
        labels = [c for c in df.columns if c != key]
    if isinstance(labels, Mapping):
        cols = [value.alias(name) for name, value in labels.items()]
    else:
        cols = [F.col(name) for name in labels]
    return df.select(key_col.cast("string").alias(KEY), *cols)


def key_defects(records: DataFrame, key: str = KEY) -> DataFrame:
    """``(record_id, defect, n_rows)`` for keys that are ``missing``, hold a ``space`` or are ``duplicate``.

    Only keys are shuffled, and they are counted before the shuffle, so a key on a third
    of the rows costs one row per task.
    """
    counts = records.groupBy(F.col(key).alias(KEY)).agg(F.count(F.lit(1)).alias("n_rows"))
    defects = F.array(
        F.when(F.col(KEY).isNull(), "missing"),
        F.when(F.contains(F.col(KEY), F.lit(" ")), "space"),
        F.when(F.col(KEY).isNotNull() & (F.col("n_rows") > 1), "duplicate"),
    )
    return counts.select(KEY, F.explode(defects).alias("defect"), "n_rows").where(F.col("defect").isNotNull())


def check_keys(records: DataFrame, key: str = KEY, mode: str = "split"):
    """``(good, bad)`` where ``bad`` is :func:`key_defects`; mode ``fail`` raises instead.

    ``good`` keeps every row whose key has no defect. The defects are written by one aggregate
    job; while they are few, the records are filtered where they are.
    """
    bad = cut(key_defects(records, key), "bad_keys")
    if mode == "fail":
        sample = [tuple(row) for row in bad.take(5)]
        if sample:
            raise InvalidKeys(f"invalid record ids, for example {sample}")
        return records, bad
    repeated = broadcast_if_small(bad.where("defect = 'duplicate'").select(F.col(KEY).alias(key)))
    good = records.where(F.col(key).isNotNull() & ~F.contains(F.col(key), F.lit(" ")))
    return good.join(repeated, key, "left_anti"), bad


def union_ids(*sets: DataFrame) -> DataFrame:
    """Distinct ids over several record sets."""
    first, *rest = [s.select(KEY) for s in sets]
    for other in rest:
        first = first.union(other)
    return first.distinct()


def merge_records(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids of both sets; for a label in both, the incoming non-NULL value wins."""
    b, i = base.alias("b"), incoming.alias("i")
    cols = []
    for name in list(base.columns) + [c for c in incoming.columns if c not in base.columns]:
        if name == KEY:
            continue
        sides = [F.col(f"{alias}.`{name}`") for alias, df in (("i", incoming), ("b", base)) if name in df.columns]
        cols.append(F.coalesce(*sides).alias(name))
    joined = b.join(i, F.col(f"b.{KEY}") == F.col(f"i.{KEY}"), "full_outer")
    return joined.select(F.coalesce(F.col(f"i.{KEY}"), F.col(f"b.{KEY}")).alias(KEY), *cols)


def input_ids(records: DataFrame) -> DataFrame:
    """The keys of a set."""
    return records.select(KEY)


def input_values(records: DataFrame) -> DataFrame:
    """The data of a set without its keys."""
    return records.drop(KEY)


def input_items(records: DataFrame) -> DataFrame:
    """Keys and data of a set."""
    return records
