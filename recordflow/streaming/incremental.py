"""Re-runs that process only what is new."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from recordflow.operators.records import KEY
from recordflow.storage import cut, cut_observed, scratch_path
from recordflow.streaming.id_index import IdIndex


class _RowCounter(StreamingQueryListener):
    """Rows of every batch of the query with this name, however many batches there are."""

    def __init__(self, name: str):
        self.name, self.rows, self.run_id, self.ended = name, 0, None, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.run_id = event.runId

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.name:
            self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.runId == self.run_id:
            self.ended.set()


def _one_version(batch: DataFrame) -> DataFrame:
    """One row of each id, the same in every run: that with the least hash of all its columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    return batch.groupBy(KEY).agg(F.min_by(whole, F.xxhash64(whole)).alias("r")).select("r.*")


def run_incremental(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    steps: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    skip_done: bool = False,
    max_files: int | None = None,
) -> int:
    """Apply per-record ``steps`` to the files that came since the last run; returns the rows read.

    The stream's checkpoint remembers the files, so calling this again takes up only new ones, at
    most ``max_files`` in each batch. ``skip_done`` leaves out records whose id is already in ``out``
    before the steps run, which makes a repeated batch harmless; of several rows of one id in a batch
    one is taken, and records without an id always are. Ids are looked up in an index beside the output, in the buckets of the batch alone
    (:mod:`recordflow.streaming.id_index`). A batch is read twice, for its ids and for the rows: these are shuffled only where ids come twice
    in it, or where both the done and the new ids are too many to be broadcast. Set steps look at a whole set and belong in a batch run.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source)
    if skip_done:

        index = IdIndex(spark, out)
        index.open()
        read: list[int] = []

        def append_new(batch: DataFrame, _: int) -> None:
            path = scratch_path(spark, "batch-ids")
            per_id = batch.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
            ids, found = cut_observed(
                per_id, f"{path}/all", n=F.count(F.lit(1)), known=F.count(KEY), rows=F.sum("n"), buckets=F.collect_set(index.bucket()))
            n, n_rows = found.get("n") or 0, found.get("rows") or 0
            index.begin()
            ids = ids.select(KEY)
            fresh, n_done = ids, 0
            if index.meta["ids"]:
                done, held = cut_observed(ids.join(index.done(found.get("buckets") or []), KEY, "left_semi"), f"{path}/done", n=F.count(F.lit(1)))
                n_done = held.get("n") or 0
                fresh = ids.join(done, KEY, "left_anti")
            new = batch if n_rows == n else _one_version(batch)
            # Of done and new ids the fewer are looked up, so that Spark can broadcast them.
            if 2 * n_done > n:
                fresh = cut(fresh, path=f"{path}/new")
                new = new.join(fresh.withColumnRenamed(KEY, "__new"), F.col(KEY).eqNullSafe(F.col("__new")), "left_semi")
            elif n_done:
                new = new.join(done, KEY, "left_anti")
            index.add(fresh.where(F.col(KEY).isNotNull()), (found.get("known") or 0) - n_done)
            steps(new).write.mode("append").parquet(out)
            index.end()
            read.append(n_rows)

        writer = stream.writeStream.foreachBatch(append_new)
    else:
        writer = steps(stream).writeStream.format("parquet").option("path", out)
    counter = _RowCounter(f"incremental-{id(stream)}")
    spark.streams.addListener(counter)
    try:
        query = writer.queryName(counter.name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        # The end is the last event of a query, behind the progress of all its batches.
        counter.ended.wait()
    finally:
        spark.streams.removeListener(counter)
    # Batches that skip done ids are read twice and would count twice.
    return sum(read) if skip_done else counter.rows
