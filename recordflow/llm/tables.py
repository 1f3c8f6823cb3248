"""Arrow helpers: one column in, results beside the kept columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.storage import cut


# Setting of Spark that bounds the bytes of an Arrow batch, on both sides, and its value here.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold a few megabytes of text at most, unless the session says how many."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def map_column(docs: DataFrame, column: str, keep: Sequence[str], results: dict[str, str],
               fn: Callable[[pa.Array], list[pa.Array]], key: str = "__in") -> DataFrame:
    """``keep`` columns and the arrays ``fn`` makes of each batch of ``column``, by Arrow batches.

    Only ``keep`` and ``column`` reach Python, each once; order and number of rows stay.
    """
    bound_batches(docs.sparkSession)
    names = list(keep)
    own = column in names and dict(docs.dtypes)[column] == "string"
    place = names.index(column) if own else len(names)
    extra = [] if own else [F.col(f"`{column}`").cast("string").alias(key)]
    picked = docs.select(*[F.col(f"`{c}`") for c in names], *extra)
    added = T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in results.items()))
    schema = T.StructType([*[picked.schema[c] for c in names], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch.column(place))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *results])

    return picked.mapInArrow(run, schema)


# Layout of monotonically_increasing_id, partition above bit 33, row below it.
_ROW_BITS = 33


def _range_sorted(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """``df`` sorted by range and written, with ``__part`` and its place ``__pos`` in that part."""
    table = cut(df.sort(*order).withColumn("__row", F.monotonically_increasing_id()), name)
    return table.withColumns({
        "__part": F.shiftright("__row", _ROW_BITS), "__pos": F.col("__row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    })


def numbered(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """Rows with their place in the whole order, from 0; no task sees more than its range."""
    table = _range_sorted(df, order, "numbered")
    # One row for each partition of the sort.
    sizes = sorted(table.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts += [F.lit(part), F.lit(total)]
        total += n
    start = F.create_map(*starts)[F.col("__part")] if starts else F.lit(0)
    return table.withColumn(name, (start + F.col("__pos")).cast("long")).drop("__row", "__part", "__pos")


def running_parts(df: DataFrame, order: Sequence[str], size: str, budget: int):
    """The ``order`` columns of the last row whose running sum of ``size`` is within ``budget``.

    Sums of the parts of a range sort, one for each partition, tell in which part the budget ends; only
    that part is summed row by row.
    """
    table = _range_sorted(df, order, "queue")
    parts = sorted(table.groupBy("__part").agg(F.sum(size).alias("n")).collect())
    before = 0
    for k, (part, n) in enumerate(parts):
        if before + n > budget or k + 1 == len(parts):
            running = F.sum(size).over(Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
            inside = table.where(F.col("__part") == part).withColumn("__sum_here", running)
            last = inside.where(F.col("__sum_here") <= budget - before).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
            if last is None and k:
                last = table.where(F.col("__part") == parts[k - 1][0]).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
            return last
        before += n
    return None
