"""A user's own loader as a data source: it plans its pieces, and hears which records and labels are wanted."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from recordflow.operators.records import KEY

BATCH_ROWS = 4096
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Loader(Protocol):
    """What a user writes. ``keys`` are the only ids wanted, or None for all; a loader may give more than is wanted."""

    schema: str  # record_id and the labels, as DDL

    def plan(self, keys: frozenset[str] | None) -> Sequence[Any]:
        """Pieces to load, one task for each; small values that can be pickled."""

    def load(self, piece: Any, keys: frozenset[str] | None, labels: Sequence[str]) -> Iterable[dict]:
        """Records of a piece, as dicts with ``record_id`` and those of ``labels`` it has."""


@dataclass
class Piece(InputPartition):
    piece: Any

    def __init__(self, piece: Any):
        super().__init__(0)
        self.piece = piece


class LoaderReader(DataSourceReader):
    def __init__(self, loader: Loader, struct: T.StructType, keys: frozenset[str] | None):
        self.loader, self.struct, self.keys = loader, struct, keys

    def partitions(self) -> list[InputPartition]:
        return [Piece(p) for p in self.loader.plan(self.keys)] or [Piece(None)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.piece is None:
            return
        arrow, names = to_arrow_schema(self.struct), self.struct.fieldNames()
        labels, rows = [n for n in names if n != KEY], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for record in self.loader.load(partition.piece, self.keys, labels):
            key = record[KEY]
            key = None if key is None else str(key)
            if self.keys is None or key in self.keys:
                rows.append([key if n == KEY else record.get(n) for n in names])
            if len(rows) >= BATCH_ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class PushingLoaderReader(LoaderReader):
    """Spark accepts this method only where filters are pushed down to Python sources."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            mine = getattr(f, "attribute", None) == (KEY,)
            if mine and isinstance(f, (EqualTo, In)):
                wanted = frozenset(v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None)
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f


def load_source(
    spark: SparkSession, loader: Loader, labels: Sequence[str] | None = None, keys: Iterable[str] | None = None
) -> DataFrame:
    """Record set of a loader, spread over one task for each piece it plans.

    Only ``labels`` (all) are asked for, and only ``keys`` (all). A filter of the result on ``record_id``, by equality or a list,
    becomes such keys where ``spark.sql.python.filterPushdown.enabled`` is on. A label that a record
    lacks is NULL; a key that is None stays NULL for ``check_keys`` to see.
    """
    struct = T.StructType.fromDDL(loader.schema)
    if KEY not in struct.fieldNames():
        raise ValueError(f"the schema needs a {KEY} field")
    unknown = set(labels or ()) - set(struct.fieldNames())
    if unknown:
        raise ValueError(f"the loader has no labels {sorted(unknown)}")
    struct = T.StructType([f for f in struct.fields if labels is None or f.name in (KEY, *labels)])
    wanted = None if keys is None else frozenset(map(str, keys))
    kind = PushingLoaderReader if spark.conf.get(PUSHDOWN, "false") == "true" else LoaderReader
    title = f"loader_{uuid.uuid4().hex}"

    class LoaderSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> T.StructType:
            return struct

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return kind(loader, struct, wanted)

    spark.dataSource.register(LoaderSource)
    return spark.read.format(title).load()
