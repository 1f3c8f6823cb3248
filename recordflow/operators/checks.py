"""Checks of step outputs against a file manifest, resume, and removal of temporary files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.functions.text import ID_PLACEHOLDER, glob_to_regex
from recordflow.operators.records import KEY, MissingLabel
from recordflow.storage import sized


class MissingOutput(RuntimeError):
    """A step ran but a declared path output does not exist."""


class MissingExport(RuntimeError):
    """A label to export is absent from a step's output."""


def _paths(path_cols: Mapping[str, Column] | Sequence[str]) -> dict[str, Column]:
    if isinstance(path_cols, Mapping):
        return dict(path_cols)
    return {name: F.col(name) for name in path_cols}


def expected_outputs(records: DataFrame, path_cols: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """``(record_id, n_expected, label, path)``, one row per non-NULL path output."""
    paths = _paths(path_cols)
    n_expected = F.lit(0).cast("long")
    for path in paths.values():
        n_expected = n_expected + path.isNotNull().cast("long")
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), path.alias("path")) for label, path in paths.items()])
    return records.select(KEY, n_expected.alias("n_expected"), F.inline(pairs)).where(F.col("path").isNotNull())


def _manifest_paths(manifest: DataFrame) -> DataFrame:
    return manifest.select("path").distinct()


def complete_ids(
    records: DataFrame, manifest: DataFrame, path_cols: Mapping[str, Column] | Sequence[str]
) -> DataFrame:
    """Ids with at least one path output of which all exist."""
    expected = expected_outputs(records, path_cols)
    found = expected.join(_manifest_paths(manifest), "path", "left_semi")
    counts = found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_found"), F.max("n_expected").alias("n_expected"))
    return counts.where("n_found = n_expected").select(KEY)


def split_complete(
    records: DataFrame, manifest: DataFrame, path_cols: Mapping[str, Column] | Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``(done, todo)`` by :func:`complete_ids`.

    The complete ids are settled by one job, which reads the manifest once for both; while they are few, the records are
    split where they are.
    """
    complete = sized(complete_ids(records, manifest, path_cols), "complete")
    return records.join(complete, KEY, "left_semi"), records.join(complete, KEY, "left_anti")


def mark_complete(
    records: DataFrame, manifest: DataFrame, path_cols: Mapping[str, Column] | Sequence[str], flag: str = "complete"
) -> DataFrame:
    """The records with a boolean ``flag`` by :func:`complete_ids`, for a step's ``complete``."""
    done = complete_ids(records, manifest, path_cols).withColumn(flag, F.lit(True))
    return records.join(done, KEY, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def missing_outputs(
    records: DataFrame, step: str, path_cols: Mapping[str, Column] | Sequence[str], manifest: DataFrame,
    condition: Column | None = None,
) -> DataFrame:
    """``(record_id, step, label, path)`` of path outputs that do not exist.

    Only records that the step ran on count, and of those only where ``condition``, if given, holds.
    """
    if f"{step}_ran" in records.columns:
        records = records.where(F.col(f"`{step}_ran`"))
    if condition is not None:
        records = records.where(condition)
    expected = expected_outputs(records, path_cols)
    lost = expected.join(_manifest_paths(manifest), "path", "left_anti")
    return lost.select(KEY, F.lit(step).alias("step"), "label", "path")


def check_outputs(
    records: DataFrame, step: str, path_cols: Mapping[str, Column] | Sequence[str], manifest: DataFrame
) -> DataFrame:
    """The records, once every path output is known to exist; raises otherwise."""
    sample = missing_outputs(records, step, path_cols, manifest).take(5)
    if sample:
        raise MissingOutput(f"missing outputs, for example {[tuple(row) for row in sample]}")
    return records


def missing_exports(records: DataFrame, step: str, labels: Sequence[str]) -> DataFrame:
    """``(record_id, step, label)`` of exported labels that are NULL where the step ran."""
    require_labels(records, step, labels)
    absent = F.array(*[F.when(F.col(f"`{step}`.`{label}`").isNull(), F.lit(label)) for label in labels])
    ran_on = records.where(F.col(f"`{step}_ran`")).select(KEY, F.lit(step).alias("step"), F.explode(absent).alias("label"))
    return ran_on.where(F.col("label").isNotNull())


def check_exports(records: DataFrame, step: str, labels: Sequence[str]) -> DataFrame:
    """The records, once every exported label is present where the step ran; raises otherwise."""
    sample = missing_exports(records, step, labels).take(5)
    if sample:
        raise MissingExport(f"missing exports, for example {[tuple(row) for row in sample]}")
    return records


def require_labels(records: DataFrame, step: str, labels: Sequence[str]) -> None:
    if not isinstance(labels, (list, tuple)):
        raise TypeError("labels to export must be a list")
    have = records.schema[step].dataType.fieldNames() if step in records.columns else []
    for label in labels:
        if label not in have:
            raise MissingLabel(f"step {step!r} has no label {label!r}")


def matches_template(path: Column, template: str, record_id: Column) -> Column:
    """Whether a path, or a folder above it, matches a glob with ``{record_id}`` filled in.

    Ids are matched literally. A template without an id is a constant pattern, compiled once.
    """
    head, *tail = template.split(ID_PLACEHOLDER)
    regex = F.lit("^(?:" + glob_to_regex(head))
    for part in tail:
        quoted = F.concat(F.lit(r"\Q"), F.replace(record_id, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        regex = F.concat(regex, quoted, F.lit(glob_to_regex(part, start=False)))
    ending = F.lit(")(?:/.*)?$")
    return F.regexp_like(path, F.concat(regex, ending)) if tail else path.rlike("^(?:" + glob_to_regex(head) + ")(?:/.*)?$")


def _is_temp(templates: Sequence[str], path: str, record_id: str) -> Column:
    hit = F.lit(False)
    for template in templates:
        hit = hit | matches_template(F.col(path), template, F.col(record_id))
    return hit


def drop_temp(
    manifest: DataFrame, templates: Sequence[str], path: str = "path", record_id: str = KEY
) -> DataFrame:
    """The manifest less files that match a templated glob, relative to the record's folder.

    The templates are part of the program, so they become one row-local predicate; a
    matching folder takes everything below it.
    """
    return manifest.where(~_is_temp(templates, path, record_id))


def temp_files(
    manifest: DataFrame, templates: Sequence[str], path: str = "path", record_id: str = KEY
) -> DataFrame:
    """The files that :func:`drop_temp` leaves out: those to delete."""
    return manifest.where(_is_temp(templates, path, record_id))


def delete_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Delete files in the tasks; ``(path, deleted)`` of each, which is false for one that is not there.

    Paths are plain, or URIs whose file system every executor reaches. Deleting is harmless to repeat: a task that is
    tried again finds its files gone. Nothing happens before the result is used; using it twice deletes nothing new.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [name is not None and _delete(name) for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.bool_())], names=["path", "deleted"])

    return files.select(F.col(path).cast("string").alias("path")).mapInArrow(run, "path string, deleted boolean")


def _delete(name: str) -> bool:
    if name.startswith("/") or name.startswith("file:"):
        system, inside = fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
    else:
        system, inside = fs.FileSystem.from_uri(name)
    if system.get_file_info(inside).type != fs.FileType.File:
        return False
    try:
        system.delete_file(inside)
    except FileNotFoundError:
        return False
    return True


def delete_temp(
    manifest: DataFrame, templates: Sequence[str], path: str = "path", record_id: str = KEY, location: str | None = None
) -> DataFrame:
    """Delete the files of :func:`temp_files`; ``(path, deleted)`` of each.

    Globs see the column ``path``, relative to the record's folder; the file itself is at ``location``, if that is another column.
    """
    return delete_files(temp_files(manifest, templates, path, record_id), location or path)
