"""Versioned store of results: whole versions are published by one file, and readers are pinned to one.

::

    store/data/batch=<id>/pipeline=<p>/step=<s>/part-*.parquet    what one write brought
    store/labels/batch=<id>/part-*.parquet                        its labels: (pipeline, step, step_no, label, n)
    store/versions/000000000007.json                              the partitions that make up version 7

A change writes its batch beside all others and then creates the next version, which names the partitions that hold from
then on. Nothing a version names is ever changed, so a reader sees a version whole, whatever is written
meanwhile, and a writer that dies before its version leaves the store as it was. Of two writers of one
version the second finds it there and applies its change to the newer one. :func:`vacuum_store` deletes what
only old versions name.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.storage import Files

RESULTS_SCHEMA = "step_no int, record_id string, label string, value string, pipeline string, step string"
LABELS_SCHEMA = "pipeline string, step string, step_no int, label string, n long"
TRIES = 20


class StoreChanged(RuntimeError):
    """Another writer replaced what a change was made from."""


@dataclass(frozen=True)
class Partition:
    """Results of one step of a pipeline, in the batch that wrote them."""

    pipeline: str | None
    step: str | None
    batch: str
    folder: str

    @property
    def key(self) -> tuple[str | None, str | None]:
        return self.pipeline, self.step


Change = Callable[[list[Partition]], list[Partition]]


def _versions(spark: SparkSession, path: str) -> Files:
    return Files(spark, path).at("versions")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Version numbers in use, the newest first; one may be of a version that is not whole."""
    return sorted((int(n.removesuffix(".json")) for n in _versions(spark, path).names() if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _read_version(spark: SparkSession, path: str, number: int) -> list[Partition] | None:
    """Partitions of a version; none if its writer died while writing it."""
    text = _versions(spark, path).at(f"{number:012d}.json").read_text()
    if not text.endswith("\n"):
        return None
    return [Partition(**entry) for entry in json.loads(text)["partitions"]]


class Snapshot:
    """One version of a store; version 0 is the empty store."""

    def __init__(self, spark: SparkSession, path: str, version: int, partitions: list[Partition]):
        self.spark, self.path, self.version, self.partitions = spark, path.rstrip("/"), version, partitions

    @property
    def results(self) -> DataFrame:
        """``(step_no, record_id, label, value, pipeline, step)``; filters on pipeline and step prune partitions."""
        if not self.partitions:
            return self.spark.createDataFrame([], RESULTS_SCHEMA)
        folders = [f"{self.path}/data/batch={p.batch}/{p.folder}" for p in self.partitions]
        read = self.spark.read.schema(RESULTS_SCHEMA + ", batch string").option("basePath", f"{self.path}/data")
        return read.parquet(*folders).drop("batch")

    @property
    def labels(self) -> DataFrame:
        """The catalogue ``(pipeline, step, step_no, label, n)``: a row for each label of a step, with its number of values."""
        if not self.partitions:
            return self.spark.createDataFrame([], LABELS_SCHEMA)
        batches = sorted({p.batch for p in self.partitions})
        read = self.spark.read.schema(LABELS_SCHEMA + ", batch string").option("basePath", f"{self.path}/labels")
        labels = read.parquet(*[f"{self.path}/labels/batch={b}" for b in batches])
        held = self.spark.createDataFrame([(p.pipeline, p.step, p.batch) for p in self.partitions], "p string, s string, b string")
        same = F.col("pipeline").eqNullSafe(F.col("p")) & F.col("step").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b"))
        return labels.join(held, same, "left_semi").drop("batch")


def open_store(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The store as it is now, or as it was at a version that has not been vacuumed."""
    for number in _numbers(spark, path) if version is None else [version]:
        partitions = [] if number == 0 else _read_version(spark, path, number)
        if partitions is not None:
            return Snapshot(spark, path, number, partitions)
    if version is not None:
        raise FileNotFoundError(f"{path} has no whole version {version}")
    return Snapshot(spark, path, 0, [])


def store_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, the newest first."""
    return [n for n in _numbers(spark, path) if _read_version(spark, path, n) is not None]


def publish(spark: SparkSession, path: str, change: Change) -> int:
    """Create the version that ``change`` makes of the newest one; its number."""
    for _ in range(TRIES):
        now = open_store(spark, path)
        number = max([0, *_numbers(spark, path)]) + 1
        entries = [vars(p) for p in sorted(change(now.partitions), key=lambda p: p.folder)]
        if _versions(spark, path).at(f"{number:012d}.json").create_text(json.dumps({"partitions": entries}, indent=1) + "\n"):
            return number
    raise StoreChanged(f"no turn in {TRIES} to change {path}")


def write_batch(results: DataFrame, path: str) -> list[Partition]:
    """Write results beside all others, with their labels; nothing sees them before they are published."""
    spark, batch = results.sparkSession, uuid.uuid4().hex
    data = f"{path.rstrip('/')}/data/batch={batch}"
    results.write.partitionBy("pipeline", "step").parquet(data)
    store = Files(spark, data)
    found = []
    for p in store.folders():
        for s in store.at(p).folders() if p.startswith("pipeline=") else []:
            found.append(Partition(_value(p), _value(s), batch, f"{p}/{s}"))
    written = spark.read.schema(RESULTS_SCHEMA).parquet(data)
    labels = written.groupBy("pipeline", "step", "step_no", "label").agg(F.count(F.lit(1)).alias("n"))
    labels.write.parquet(f"{path.rstrip('/')}/labels/batch={batch}")
    return found


def _value(folder: str) -> str | None:
    value = unquote(folder.partition("=")[2])
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


def vacuum_store(spark: SparkSession, path: str, keep: int = 1, older_than: float = 86_400.0) -> list[str]:
    """Delete all versions but the newest ``keep``, and batches that none of those names; the ids of these batches.

    Batches younger than ``older_than`` seconds stay, as their writer may be about to publish them. Readers of
    a deleted version fail.
    """
    if keep < 1:
        raise ValueError("the newest version stays")
    whole = store_versions(spark, path)
    kept = whole[:keep]
    live = {p.batch for n in kept for p in _read_version(spark, path, n)}
    for number in _numbers(spark, path):
        if kept and number < kept[-1]:
            _versions(spark, path).at(f"{number:012d}.json").delete()
    gone: Sequence[str] = []
    for kind in ("data", "labels"):
        folder = Files(spark, path).at(kind)
        for name in folder.folders():
            batch = folder.at(name)
            if name.removeprefix("batch=") not in live and batch.modified() <= time.time() - older_than:
                batch.delete()
                gone = [*gone, name.removeprefix("batch=")] if kind == "data" else gone
    return sorted(gone)
