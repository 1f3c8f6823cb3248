"""Per-record Python steps with a log of time, status and error."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recordflow.operators.records import KEY
from recordflow.operators.steps import arrow_step
from recordflow.storage import cut

OK, FAILED, SKIPPED = "ok", "failed", "skipped"


def logged_step(
    records: DataFrame,
    name: str,
    fn: Callable[[dict], dict],
    schema: str,
    inputs: Sequence[str],
    condition: Column | None = None,
    mode: str = "fail",
) -> DataFrame:
    """Step of a Python function of one record's inputs, timed and with errors captured.

    Adds ``<name>``, ``<name>_ran`` and ``<name>_log STRUCT<status, seconds, error>``. Mode
    ``fail`` raises on the first error, with the record's id; ``quarantine`` keeps the error text.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode is 'fail' or 'quarantine'")
    labels = T.StructType.fromDDL(schema)
    log = T.StructType.fromDDL("__status string, __seconds double, __error string")
    names = list(dict.fromkeys([KEY, *inputs]))

    def call(batch: pa.StructArray) -> list[pa.Array]:
        rows = []
        for values in batch.to_pylist():
            start, error, out = time.perf_counter(), None, {}
            try:
                out = fn({k: values[k] for k in inputs}) or {}
            except Exception as err:
                if mode == "fail":
                    raise RuntimeError(f"step {name} failed on record {values[KEY]}") from err
                error = "".join(traceback.format_exception_only(err)).strip()
            seconds = time.perf_counter() - start
            rows.append([out.get(label) for label in labels.fieldNames()] + [FAILED if error else OK, seconds, error])
        return [pa.array([row[k] for row in rows], f.type) for k, f in enumerate(fields)]

    both = T.StructType(labels.fields + log.fields)
    fields = list(to_arrow_schema(both))
    stepped = arrow_step(records, name, call, both, names, condition)
    step_log = F.struct(
        F.coalesce(F.col(f"`{name}`.__status"), F.lit(SKIPPED)).alias("status"),
        F.col(f"`{name}`.__seconds").alias("seconds"),
        F.col(f"`{name}`.__error").alias("error"),
    )
    result = F.struct(*[F.col(f"`{name}`.`{label}`").alias(label) for label in labels.fieldNames()])
    return stepped.withColumn(f"{name}_log", step_log).withColumn(name, result)


def run_once(records: DataFrame, name: str) -> DataFrame:
    """The records with the step's results written, so that all that is made of them runs the step only once."""
    return cut(records, f"step-{name}")


def split_errors(records: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: ``bad`` holds the records the step failed on. The step runs once for both."""
    records = run_once(records, name)
    failed = F.col(f"`{name}_log`.status") == FAILED
    return records.where(~failed), records.where(failed)


def run_log(records: DataFrame, step: str, run: str = "") -> DataFrame:
    """Log table ``(pipeline, step, record_id, status, seconds, error)`` of a logged step.

    Use it on the records of :func:`run_once` where the results are used too.
    """
    return records.select(
        F.lit(run).alias("pipeline"), F.lit(step).alias("step"), KEY, F.col(f"`{step}_log`.*")
    )
