"""Shared storage and the size check behind every broadcast hint.

Intermediate tables go below the folder named by ``spark.checkpoint.dir``,
which every executor can reach, so losing an executor never loses a table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder.

    A temporary folder is used only in local mode, when the session names none.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="recordflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder that holds all intermediate tables of this session's application."""
    return f"{shared_dir(spark)}/recordflow/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the run's folder; nothing is ever overwritten there."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the run's intermediate tables. DataFrames that still read them fail from now on."""
    files = Files(spark, run_dir(spark))
    if files.exists():
        files.delete()


class Files:
    """A path in the file system Spark sees it in: a few metadata calls on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.name = spark, path.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.name)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, child: str) -> Files:
        return Files(self.spark, f"{self.name}/{child}")

    def beside(self, name: str) -> Files:
        """A new path in the same folder, hidden from readers."""
        parent, _, last = self.name.rpartition("/")
        return Files(self.spark, f"{parent}/_{name}-{last}-{uuid.uuid4().hex}")

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def delete(self) -> None:
        self.system.delete(self.path, True)

    def move_to(self, target: Files) -> None:
        """Rename; the target's parent is made, the target must not exist."""
        self.system.mkdirs(target.path.getParent())
        if not self.system.rename(self.path, target.path):
            raise OSError(f"cannot move {self.name} to {target.name}")

    def folders(self) -> list[str]:
        """Names of the visible folders inside."""
        if not self.exists():
            return []
        found = [x.getPath().getName() for x in self.system.listStatus(self.path) if x.isDirectory()]
        return sorted(n for n in found if not n.startswith(("_", ".")))


    def names(self) -> list[str]:
        """Names of everything inside."""
        return sorted(x.getPath().getName() for x in self.system.listStatus(self.path)) if self.exists() else []

    def modified(self) -> float:
        """Time of the last change, in seconds."""
        return self.system.getFileStatus(self.path).getModificationTime() / 1000

    def create_text(self, text: str) -> bool:
        """Create a small file; whether it was not there."""
        try:
            out = self.system.create(self.path, False)
        except Py4JJavaError as err:
            if "AlreadyExists" in err.java_exception.getClass().getName() or self.exists():
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def read_text(self) -> str:
        stream = self.system.open(self.path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def write_once(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` a table beside ``path`` and move it there, unless a whole copy is there already.

    A copy is whole if it has the mark of a committed job; a broken one is replaced.
    """
    target = Files(spark, path)
    if target.at("_SUCCESS").exists():
        return
    side = target.beside("writing")
    write(side.name)
    if target.exists():
        target.delete()
    side.move_to(target)


def cut(df: DataFrame, name: str = "cut", path: str | None = None, by: str | None = None, row_group: int | None = None) -> DataFrame:
    """Write ``df`` once, in a folder for each value of its last column ``by`` if given, and return a scan of the written table.

    Cuts lineage like ``checkpoint()``, and gives the optimizer the exact size of the
    table, so Spark's own ``autoBroadcastJoinThreshold`` can pick the join strategy. Row groups of at most ``row_group`` bytes
    let several tasks read a file that one task wrote.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_observed(df: DataFrame, path: str, by: str | None = None, row_group: int | None = None, **aggregates: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, with aggregates observed by the job that writes the table, as they are."""
    seen = Observation()
    table = cut(df.observe(seen, *[value.alias(name) for name, value in aggregates.items()]), path=path, by=by, row_group=row_group)
    return table, dict(seen.get)


def cut_counted(df: DataFrame, path: str, row_group: int | None = None, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, with counts observed by the job that writes the table.

    ``n`` counts the rows; other aggregates are named by keyword.
    """
    table, found = cut_observed(df, path, row_group=row_group, n=F.count(F.lit(1)), **counts)
    return table, {name: int(found.get(name) or 0) for name in ["n", *counts]}


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size of ``df`` is within ``max_bytes``.

    Beyond that the table comes back without a hint and Spark shuffles, with AQE
    splitting skewed keys. The measurement is one aggregate over ``df``.
    """
    row_size = F.lit(16)
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            row_size = row_size + F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            row_size = row_size + F.octet_length(F.to_json(F.struct(column)))
        else:
            row_size = row_size + 8
    size = df.agg(F.sum(row_size.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def sized(df: DataFrame, name: str = "sized") -> DataFrame:
    """``df`` written once and hinted by its measured size.

    For a derived table that decides how a much larger one is joined: Spark's estimate of it
    would be far too high, and the larger table would be shuffled for nothing.
    """
    return broadcast_if_small(cut(df, name))
