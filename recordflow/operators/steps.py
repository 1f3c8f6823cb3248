"""Per-record steps.

A step adds one struct column named after it (its labels) and a boolean ``<step>_ran``.
Declared labels are computed for every record; run labels only where the step's gate
holds: its condition (NULL counts as true), its parent's gate, and no static skip. A record
marked ``complete`` has its outputs from an earlier run: it counts as run, so that it is
exported, but nothing is computed for it again.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recordflow.functions.text import ROOT, is_true
from recordflow.operators.records import KEY, MissingLabel

Binding = Mapping[str, Mapping[str, str] | Sequence[str]]
StepFunction = Callable[[DataFrame, Column], DataFrame]


@dataclass(frozen=True)
class Dependency:
    """A step reused by another one, with the labels bound to its inputs.

    ``step`` takes the record set and the parent's gate. ``rename`` maps the name the step
    writes to the name it should have here.
    """

    step: StepFunction
    binding: Binding | None = None
    rename: Mapping[str, str] | None = None


def ran(name: str) -> str:
    return f"{name}_ran"


def has_run(records: DataFrame, name: str) -> Column:
    """Whether a record has a result of the step, even one it was skipped in."""
    if name in records.columns:
        return F.col(f"`{name}`").isNotNull()
    # A step without labels is known by its flag alone.
    return F.col(f"`{ran(name)}`").isNotNull() if ran(name) in records.columns else F.lit(False)


def did_run(records: DataFrame, name: str) -> Column:
    """Whether the step really ran for a record."""
    return F.coalesce(F.col(f"`{ran(name)}`"), F.lit(False)) if ran(name) in records.columns else F.lit(False)


def is_skipped(setting: object) -> bool:
    """Static skip setting: only the text ``true``, in any case, counts."""
    return str(setting).lower() == "true"


def _gate(condition: Column | None, skip: object, gate: Column | None) -> Column:
    if isinstance(skip, Column):
        open_ = ~is_true(skip)
    else:
        open_ = F.lit(not is_skipped(skip))
    if condition is not None:
        open_ = open_ & F.coalesce(condition.cast("boolean"), F.lit(True))
    return open_ if gate is None else open_ & F.coalesce(gate, F.lit(False))


def _with_gate(records, name, condition, skip, gate, depends) -> DataFrame:
    """Add ``<name>_ran`` and then what the dependencies produce under that gate."""
    clash = [c for c in records.columns if c.lower() == name.lower() and c != name]
    if clash:
        raise ValueError(f"step {name!r} and label {clash[0]!r} differ by case alone")
    records = records.withColumn(ran(name), _gate(condition, skip, gate))
    for dependency in depends:
        records = use_step(
            records, dependency.step, dependency.binding, F.col(f"`{ran(name)}`"), dependency.rename
        )
    return records


def _open(name: str, complete: Column | None) -> Column:
    """Where the run labels are computed."""
    gate = F.col(f"`{ran(name)}`")
    return gate if complete is None else gate & ~F.coalesce(complete, F.lit(False))


def _put_step(records: DataFrame, name: str, struct: Column) -> DataFrame:
    """Add or replace the step's struct, keeping ``<name>_ran`` right after it."""
    keep = [f"`{c}`" for c in records.columns if c not in (name, ran(name))]
    return records.select(*keep, struct.alias(name), F.col(f"`{ran(name)}`"))


def map_step(
    records: DataFrame,
    name: str,
    declare: Mapping[str, Column] | None = None,
    run: Mapping[str, Column] | None = None,
    condition: Column | None = None,
    skip: object = False,
    depends: Sequence[Dependency] = (),
    gate: Column | None = None,
    complete: Column | None = None,
) -> DataFrame:
    """Step of column expressions.

    A label both declared and run has the declared value where the step does not run.
    A step without labels adds only its ``_ran`` flag.
    """
    declare, run = dict(declare or {}), dict(run or {})
    records = _with_gate(records, name, condition, skip, gate, depends)
    if not declare and not run:
        return records
    open_ = _open(name, complete)
    fields = []
    for label in list(declare) + [x for x in run if x not in declare]:
        value = declare.get(label)
        if label in run:
            gated = F.when(open_, run[label])
            value = gated if value is None else gated.otherwise(value)
        fields.append(value.alias(label))
    return _put_step(records, name, F.struct(*fields))


def _struct_type(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


# Integers and flags stay exact beside NULLs.
_NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype(),
}


def _to_frame(batch: pa.StructArray) -> pd.DataFrame:
    frame = pa.Table.from_struct_array(batch).to_pandas(types_mapper=_NULLABLE.get)
    for name, kind in zip(batch.type.names, (f.type for f in batch.type), strict=True):
        if pa.types.is_timestamp(kind) and kind.tz:
            frame[name] = frame[name].dt.tz_localize(None)
    return frame


def arrow_step(
    records: DataFrame,
    name: str,
    fn: Callable[[pa.StructArray], Sequence[pa.Array]],
    schema: str | T.StructType,
    inputs: Sequence[str | Column],
    condition: Column | None = None,
    skip: object = False,
    depends: Sequence[Dependency] = (),
    gate: Column | None = None,
    complete: Column | None = None,
) -> DataFrame:
    """Step of a function over Arrow batches of the ``inputs``, one array for each label of ``schema``.

    ``fn`` gets only the rows where the gate holds; for all others a single NULL leaves the JVM.
    """
    struct_type = _struct_type(schema)
    arrow_type = pa.struct(list(to_arrow_schema(struct_type)))
    records = _with_gate(records, name, condition, skip, gate, depends)

    def call(packed: pa.Array) -> pa.Array:
        open_rows = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False))
        made: list[pa.Array] = [pa.nulls(0, f.type) for f in arrow_type]
        if len(open_rows):
            made = [m.cast(f.type) for m, f in zip(fn(packed.take(pa.array(open_rows))), arrow_type, strict=True)]
            if any(len(m) != len(open_rows) for m in made):
                raise ValueError(f"step {name}: {len(made[0])} rows returned for {len(open_rows)} records")
        place = np.full(len(packed), -1, dtype=np.int64)
        place[open_rows] = np.arange(len(open_rows))
        at = pa.array(place, mask=place < 0)
        return pa.StructArray.from_arrays([m.take(at) for m in made], fields=list(arrow_type))

    columns = [F.col(c) if isinstance(c, str) else c for c in inputs]
    packed = F.when(_open(name, complete), F.struct(*columns))
    return _put_step(records, name, F.arrow_udf(call, struct_type)(packed))


def map_step_py(
    records: DataFrame,
    name: str,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    inputs: Sequence[str | Column],
    condition: Column | None = None,
    skip: object = False,
    depends: Sequence[Dependency] = (),
    gate: Column | None = None,
    complete: Column | None = None,
) -> DataFrame:
    """Step of a pandas function over Arrow batches.

    ``fn`` gets a batch of the ``inputs`` columns, only the rows where the gate holds, and
    returns as many rows of ``schema``. Integers and flags have nullable types, so a NULL changes
    no other value. Other columns, and rows behind a closed gate, never leave the JVM.
    """
    struct_type = _struct_type(schema)
    fields = list(to_arrow_schema(struct_type))

    def call(batch: pa.StructArray) -> list[pa.Array]:
        produced = fn(_to_frame(batch))
        return [pa.Array.from_pandas(produced[f.name], type=f.type) for f in fields]

    return arrow_step(records, name, call, struct_type, inputs, condition, skip, depends, gate, complete)


def pipe_step(
    records: DataFrame,
    name: str,
    command: Sequence[str],
    value: Column,
    label: str = "result",
    condition: Column | None = None,
    skip: object = False,
    depends: Sequence[Dependency] = (),
    gate: Column | None = None,
    complete: Column | None = None,
) -> DataFrame:
    """Step of an external line-to-line command: one line in, one line out per record.

    One process serves an Arrow batch. Lines are matched by position, so the command never
    sees the keys. A non-zero exit, a value of several lines or a wrong number of lines fails.
    """
    command = list(command)

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        lines = batch["value"]
        filled = lines[lines.notna()]
        if filled.str.contains("\n", regex=False).any():
            raise ValueError(f"step {name}: a value holds a line break")
        done = subprocess.run(
            command, input="".join(f"{x}\n" for x in filled).encode(), capture_output=True, check=False
        )
        if done.returncode != 0:
            raise RuntimeError(f"step {name}: exit {done.returncode}: {done.stderr.decode(errors='replace')[-2000:]}")
        produced = done.stdout.decode().split("\n")[:-1]
        if len(produced) != len(filled):
            raise RuntimeError(f"step {name}: {len(produced)} lines returned for {len(filled)}")
        out = pd.Series([None] * len(lines), dtype=object)
        out[lines.notna().to_numpy()] = produced
        return pd.DataFrame({label: out})

    schema = T.StructType([T.StructField(label, T.StringType())])
    inputs = [value.cast("string").alias("value")]
    return map_step_py(records, name, call, schema, inputs, condition, skip, depends, gate, complete)


def _resolve(records: DataFrame, owner: str, label: str) -> Column:
    """Column of ``label`` in step ``owner``, or of a root label; error when absent."""
    if owner.lower() == ROOT:
        if label not in records.columns:
            raise MissingLabel(f"no root label {label!r}")
        return F.col(f"`{label}`")
    if owner not in records.columns:
        raise MissingLabel(f"no step {owner!r}")
    step_type = records.schema[owner].dataType
    if not isinstance(step_type, T.StructType) or label not in step_type.fieldNames():
        raise MissingLabel(f"step {owner!r} has no label {label!r}")
    return F.col(f"`{owner}`.`{label}`")


def bound_columns(records: DataFrame, binding: Binding | None) -> dict[str, Column]:
    """``{input name: column}`` of a binding ``{step or "root": {from: to} or [label]}``."""
    out: dict[str, Column] = {}
    for owner, wanted in (binding or {}).items():
        pairs = wanted.items() if isinstance(wanted, Mapping) else [(label, label) for label in wanted]
        for source, target in pairs:
            out[target] = _resolve(records, owner, source)
    return out


def bind_inputs(records: DataFrame, binding: Binding | None, only: bool = False) -> DataFrame:
    """Input view of a reused step: bound labels added over the record's own.

    ``only`` keeps the key and the bound labels alone. No binding leaves everything as it is.
    """
    bound = bound_columns(records, binding)
    if only:
        return records.select(KEY, *[value.alias(name) for name, value in bound.items()])
    return records.withColumns(bound) if bound else records


def use_step(
    records: DataFrame,
    step: StepFunction,
    binding: Binding | None = None,
    gate: Column | None = None,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run a reusable step on bound inputs; the bindings are gone afterwards.

    ``rename`` keeps the step's result under another name, so that several uses of one step
    do not overwrite each other.
    """
    rename = dict(rename or {})
    bound = bound_columns(records, binding)
    hidden = {name: f"__outer_{name}" for name in list(bound) + list(rename) if name in records.columns}
    hidden |= {ran(n): f"__outer_{ran(n)}" for n in rename if ran(n) in records.columns}
    outer_gate = F.lit(True) if gate is None else gate
    view = records.withColumns({"__gate": outer_gate} | {h: F.col(f"`{n}`") for n, h in hidden.items()} | bound)
    before = [c for c in records.columns]
    after = step(view, F.col("__gate"))
    kept = []
    for column in before:
        kept.append(F.col(f"`{hidden.get(column, column)}`").alias(column))
    targets = {}
    for column in after.columns:
        renamed = column in rename or any(column == ran(n) for n in rename)
        if column == "__gate" or column in hidden.values() or (column in bound and not renamed):
            continue
        if renamed:
            base = column if column in rename else column[: -len("_ran")]
            targets[rename[base] if column in rename else ran(rename[base])] = column
        elif column not in before:
            targets[column] = column
    kept = [c for c, name in zip(kept, before) if name not in targets]
    return after.select(*kept, *[F.col(f"`{source}`").alias(name) for name, source in targets.items()])
