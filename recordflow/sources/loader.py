"""Record sets from a user's own Python loader."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recordflow.operators.records import KEY


def load_records(
    parts: DataFrame, load: Callable[[dict], Iterable[dict]], schema: str | T.StructType, batch_rows: int = 4096
) -> DataFrame:
    """Record set of what ``load`` yields for each row of ``parts``, spread over the tasks.

    A part describes a piece of input: a path, a shard, a date. ``load`` gets it as a dict and
    yields records as dicts with ``record_id`` and the labels of ``schema``; a label that a
    record lacks is NULL, and a key that is None stays NULL for ``check_keys`` to see. Parts are loaded where they are and never gathered.
    """
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    if KEY not in names:
        raise ValueError(f"the schema needs a {KEY} field")

    arrow = to_arrow_schema(struct)

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for given in batches:
            for part in given.to_pylist():
                for record in load(part):
                    values = [record.get(name) for name in names]
                    key = record[KEY]
                    values[names.index(KEY)] = None if key is None else str(key)
                    rows.append(values)
                    if len(rows) >= batch_rows:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return parts.mapInArrow(call, struct)
