"""Index of the ids in an output: hash buckets beside it, of which a batch reads only its own.

::

    <out>/_ids/meta.json                           generation, its number of buckets and of ids
    <out>/_ids/pending                             there while a batch is being written
    <out>/_ids/generation=<g>/bucket=<k>/part-*    ids

Buckets stay at about ``IDS_PER_BUCKET`` ids: when there are twice as many, the next generation has more of them. So
what a batch reads follows its own ids and not the history. A batch that dies leaves its mark, and an index that is
missing or marked is made anew from the output, which always tells the truth.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.operators.records import KEY
from recordflow.storage import Files, cut_counted, scratch_path

IDS_PER_BUCKET = 200_000


class IdIndex:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self.folder = Files(spark, f"{self.out}/_ids")
        self.meta: dict[str, int] = {}

    def open(self) -> None:
        """Read the index's description; make the index anew if it does not match the output."""
        meta = self.folder.at("meta.json")
        self.meta = json.loads(meta.read_text()) if meta.exists() else {}
        if not self.meta or self.folder.at("pending").exists():
            ids, size = cut_counted(self._output_ids().where(F.col(KEY).isNotNull()).distinct(), scratch_path(self.spark, "output-ids"))
            self._rebuild(ids, size["n"])
            self.folder.at("pending").delete()

    def _output_ids(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{KEY} string").parquet(self.out)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{KEY} string")

    def _generation(self) -> str:
        return f"{self.folder.name}/generation={self.meta['generation']}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(KEY), F.lit(self.meta["buckets"])).cast("int")

    def _rebuild(self, ids: DataFrame, n: int) -> None:
        """A new generation of ``n`` distinct ids, none NULL."""
        buckets = 1
        while buckets * IDS_PER_BUCKET < n:
            buckets *= 2
        old = self.meta.get("generation", 0)
        self.meta = {"generation": max([old, *(int(f.partition("=")[2]) for f in self.folder.folders())]) + 1, "buckets": buckets, "ids": n}
        if n:
            self._write(ids)
        self._save()
        for name in self.folder.folders():
            if name != f"generation={self.meta['generation']}":
                self.folder.at(name).delete()

    def _write(self, ids: DataFrame) -> None:
        dealt = ids.withColumn("bucket", self.bucket())
        if self.meta["buckets"] > 1:
            dealt = dealt.hint("rebalance", "bucket")
        dealt.write.mode("append").partitionBy("bucket").parquet(self._generation())

    def _save(self) -> None:
        meta = self.folder.at("meta.json")
        if meta.exists():
            meta.delete()
        meta.create_text(json.dumps(self.meta))

    def done(self, ids: DataFrame | Iterable[int | None]) -> DataFrame:
        """Done ids of the buckets that ``ids`` are in, or of these buckets."""
        # At most a number for each bucket.
        if isinstance(ids, DataFrame):
            ids = [r["b"] for r in ids.select(self.bucket().alias("b")).distinct().collect()]
        buckets = sorted({b for b in ids if b is not None})
        if not self.meta["ids"]:
            return self.spark.createDataFrame([], f"{KEY} string")
        held = self.spark.read.schema(f"{KEY} string, bucket int").parquet(self._generation())
        if len(buckets) < self.meta["buckets"]:
            held = held.where(F.col("bucket").isin(buckets))
        return held.select(KEY)

    def begin(self) -> None:
        """Mark that a batch is being written."""
        self.folder.at("pending").create_text("")

    def add(self, ids: DataFrame, n: int) -> None:
        """Add ``n`` ids that are not in the index; with more buckets, if there are too many for these."""
        held = self.meta["ids"]
        if held + n <= 2 * self.meta["buckets"] * IDS_PER_BUCKET:
            if n:
                self._write(ids)
            self.meta["ids"] += n
            return
        if held:
            ids = ids.union(self.spark.read.schema(f"{KEY} string").parquet(self._generation()).select(KEY))
        self._rebuild(ids, held + n)

    def end(self) -> None:
        """The batch is written: the index holds it from now on."""
        self._save()
        self.folder.at("pending").delete()
