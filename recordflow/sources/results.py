"""Results: exported labels in long form, kept in a versioned store with one partition per pipeline and step.

``(pipeline, step, step_no INT, record_id, label, value STRING)``
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.functions.text import ROOT, export_name
from recordflow.operators.checks import require_labels
from recordflow.operators.lineage import downstream
from recordflow.operators.records import KEY
from recordflow.sources.store import Partition, Snapshot, StoreChanged, open_store, publish, write_batch
from recordflow.storage import sized

ALL = "all"

Request = str | Mapping[str, str] | Sequence[str | Mapping[str, str]]


class ImproperInput(ValueError):
    """A request for results that names an unknown pipeline or label, or has another form."""


def export_steps(
    records: DataFrame, exports: Mapping[str, Sequence[str]], run: str, first_no: int = 1,
    path_labels: Sequence[str] = (), folder: str = "",
) -> DataFrame:
    """Long rows of the labels of several steps, in one pass over the records.

    ``exports`` maps a step to its labels, in run order: step numbers count from ``first_no``.
    A record gives rows for the steps that ran on it; a NULL value fails. ``run`` names the
    exporting pipeline. The value of a label in ``path_labels`` is the path of its copy in ``folder``, see
    :func:`export_plan`.
    """
    entries = []
    for step_no, (step, labels) in enumerate(exports.items(), first_no):
        require_labels(records, step, labels)
        for label in labels:
            value = F.col(f"`{step}`.`{label}`").cast("string")
            if label in path_labels:
                value = exported_path(value, step, folder)
            entries += [F.lit(step), F.lit(step_no), F.lit(label), value, F.col(f"`{step}_ran`")]
    names = ("step", "step_no", "label", "value", "ran")
    rows = records.select(KEY, F.stack(F.lit(len(entries) // len(names)), *entries).alias(*names)).where("ran")
    problem = F.raise_error(F.concat_ws(" ", F.lit("no value to export for"), F.col("step"), F.col("label"), F.col(KEY)))
    filled = F.when(F.col("value").isNotNull(), F.lit(True)).otherwise(problem.cast("boolean"))
    return rows.where(filled).select(F.lit(run).alias("pipeline"), "step", "step_no", KEY, "label", "value")


def export_results(
    records: DataFrame, step: str, labels: Sequence[str], run: str, step_no: int
) -> DataFrame:
    """Long rows of one step's labels for the records it ran on; a NULL value fails."""
    return export_steps(records, {step: labels}, run, step_no)


def write_results(results: DataFrame, path: str, pipeline: str | None = None, steps: Sequence[str] | None = None) -> int:
    """Store results as a new version, whose number is returned; the written pipelines and steps are replaced as a whole.

    With ``pipeline``, stored steps of that pipeline without rows in ``results`` go too: all of them, or those
    of ``steps``. So a re-run leaves nothing of steps that no longer run.
    """
    new = write_batch(results, path)
    written = {p.key for p in new}

    def change(held: list[Partition]) -> list[Partition]:
        stale = lambda p: pipeline is not None and p.pipeline == pipeline and (steps is None or p.step in steps)
        return [p for p in held if p.key not in written and not stale(p)] + new

    return publish(results.sparkSession, path, change)


def read_results(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored results, now or at a version; filters on pipeline and step prune partitions."""
    return open_store(spark, path, version).results


def latest(results: DataFrame | Snapshot) -> DataFrame:
    """The value of the last step for each pipeline, record and label.

    In a store, labels that one step alone exports are found in the catalogue and passed on as they are.
    """
    place = F.struct("step_no", "step")
    columns = ["pipeline", KEY, "label", "value"]
    if not isinstance(results, Snapshot):
        return results.groupBy("pipeline", KEY, "label").agg(F.max_by("value", place).alias("value"))
    steps = results.labels.groupBy("pipeline", "label").agg(F.count_distinct("step_no", "step").alias("n"))
    shared = sized(steps.where("n > 1").select("pipeline", "label"), "shared-labels")
    alone = results.results.join(shared, ["pipeline", "label"], "left_anti").select(*columns)
    if shared.isEmpty():
        return alone
    return alone.union(latest(results.results.join(shared, ["pipeline", "label"], "left_semi")).select(*columns))


def _pairs(run: str, request: Request, present: Mapping[str, Iterable[str]]) -> list[tuple[str, str]]:
    """``(to, from)`` label pairs of one pipeline's request, in order."""
    if isinstance(request, str):
        return [(x, x) for x in sorted(present[run])] if request == ALL else [(request, request)]
    if isinstance(request, Mapping):
        return list(request.items())
    if not isinstance(request, Sequence):
        raise ImproperInput(f"request for {run} is neither a label, a list nor a mapping")
    out: list[tuple[str, str]] = []
    for item in request:
        if not isinstance(item, (str, Mapping)):
            raise ImproperInput(f"request for {run} holds something else than labels and mappings")
        out += _pairs(run, item, present)
    return out


def _asked(run: str, request: Request) -> set[str]:
    """Labels that a request names; :data:`ALL` among them if it asks for all."""
    if isinstance(request, str):
        return {request}
    return {label for _, label in _pairs(run, request, _Everything())}


class _Everything(dict):
    """Stands for the labels of any pipeline while only the named ones are read off a request."""

    def __missing__(self, run: str) -> set[str]:
        return {ALL}


# By pipeline and label, the steps that export it; none are known for results without a catalogue.
Present = dict[str, dict[str, set[str | None]]]


def _present(source: DataFrame | Snapshot, spec: Mapping[str, Request]) -> Present:
    """Labels by pipeline, of those asked for, with their steps: from the catalogue, or from the rows."""
    named = F.lit(False)
    for run, request in spec.items():
        asked = _asked(run, request)
        mine = F.col("pipeline") == run
        named = named | (mine if ALL in asked else mine & F.col("label").isin(sorted(asked)))
    known = isinstance(source, Snapshot)
    names = source.labels if known else source
    present: Present = {}
    for row in names.where(named).select("pipeline", "label", *["step"] * known).distinct().collect():
        present.setdefault(row["pipeline"], {}).setdefault(row["label"], set()).update([row["step"]] if known else [])
    for run in spec:
        if run not in present:
            if names.where(F.col("pipeline") == run).isEmpty():
                raise ImproperInput(f"no results of {run}")
            present[run] = {}
    return present


def load_results(results: DataFrame | Snapshot, spec: Mapping[str, Request], ids: DataFrame | None = None) -> DataFrame:
    """Exported labels of other pipelines as a record set, one text column per label.

    ``spec`` maps a pipeline to ``"all"``, a label, ``{to: from}`` or a list of these; for one
    target requested twice the later request wins where it has a value. The name ``root`` is
    ignored. ``ids`` adds records that exported nothing. An unknown pipeline or label is an error.

    A store (:func:`open_store`) tells from its catalogue which labels there are and which steps hold them: only
    those partitions are read, no result row is read for names, and a single label of one step is a projection.
    For a table of results the names asked for are found by one aggregate over its rows, which computes a lazy table twice.
    """
    spec = {run: request for run, request in spec.items() if run != ROOT}
    known = isinstance(results, Snapshot)
    wanted = results if known else results.where(F.col("pipeline").isin(list(spec)))
    present = _present(wanted, spec)
    place = F.struct("step_no", "step")
    targets: dict[str, list[Column]] = {}
    sources: dict[str, list[str]] = {}
    for run, request in spec.items():
        for target, label in _pairs(run, request, present):
            if label not in present[run]:
                raise ImproperInput(f"{run} has no results for {label}")
            mine = (F.col("pipeline") == run) & (F.col("label") == label)
            value = F.max_by(F.when(mine, F.col("value")), F.when(mine, place))
            targets.setdefault(target, []).insert(0, value)
            sources.setdefault(run, []).append(label)
    requested, steps = F.lit(False), set()
    for run, labels in sources.items():
        mine = (F.col("pipeline") == run) & F.col("label").isin(labels)
        if known:
            holding = {s for label in labels for s in present[run][label]}
            steps |= {(run, s) for s in holding}
            mine = mine & (F.col("step").isin([s for s in holding if s is not None]) | F.lit(None in holding) & F.col("step").isNull())
        requested = requested | mine
    rows = (wanted.results if known else wanted).where(requested)
    if known and len(targets) == 1 and len(steps) == 1 and sum(map(len, sources.values())) == 1:
        loaded = rows.select(KEY, F.col("value").alias(*targets))
    else:
        loaded = rows.groupBy(KEY).agg(
            *[(F.coalesce(*values) if len(values) > 1 else values[0]).alias(target) for target, values in targets.items()]
        )
    if ids is None:
        return loaded
    return ids.select(KEY).distinct().join(loaded, KEY, "full_outer")


def remove_ids(tables: Sequence[DataFrame], ids: DataFrame) -> list[DataFrame]:
    """Every table without the rows of ``ids``; unknown ids are ignored.

    The ids are written once for all tables; while they are few, the tables are filtered where they are.
    """
    gone = sized(ids.select(KEY).distinct(), "removed")
    return [table.join(gone, KEY, "left_anti") for table in tables]


def purge_steps(results: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Results without those of ``steps`` (column ``node``) and of every step that requires them.

    A step may hold most of the results, so while the stale names are measured as small the
    results are filtered where they are.
    """
    stale = downstream(edges, steps).select(F.col("node").alias("step")).distinct()
    return results.join(sized(stale, "stale"), "step", "left_anti").select(*results.columns)


def purge_store(spark: SparkSession, path: str, edges: DataFrame, steps: DataFrame) -> list[tuple[str, str]]:
    """Leave out the results of ``steps`` (column ``node``) and of every step that requires them from a new version.

    Whole partitions go, nothing is read or written; returns the ``(pipeline, step)`` left out.
    """
    now = open_store(spark, path)
    stored = spark.createDataFrame([(p.step,) for p in now.partitions], "step string")
    stale = downstream(edges, steps).select(F.col("node").cast("string").alias("step")).distinct()
    # At most one name for each partition.
    gone = {row["step"] for row in stored.distinct().join(stale, "step", "left_semi").collect()}
    dropped = [p.key for p in now.partitions if p.step in gone]
    if dropped:
        publish(spark, path, lambda held: [p for p in held if p.step not in gone])
    return dropped


def remove_from_store(spark: SparkSession, path: str, ids: DataFrame) -> list[tuple[str, str]]:
    """Remove all results of ``ids`` in a new version; returns the ``(pipeline, step)`` it touched.

    Only partitions with such ids are written anew; those that end up empty are left out. If another writer
    replaces one of them meanwhile, nothing is published and :class:`StoreChanged` is raised.
    """
    now = open_store(spark, path)
    gone = sized(ids.select(KEY).distinct(), "removed")
    # One row for each partition at most.
    touched = {tuple(r) for r in now.results.join(gone, KEY, "left_semi").select("pipeline", "step").distinct().collect()}
    if not touched:
        return []
    old = [p for p in now.partitions if p.key in touched]
    new = write_batch(Snapshot(spark, path, now.version, old).results.join(gone, KEY, "left_anti"), path)

    def change(held: list[Partition]) -> list[Partition]:
        if any(p not in held for p in old):
            raise StoreChanged(f"{path} was changed while ids were removed from it")
        return [p for p in held if p.key not in touched] + new

    publish(spark, path, change)
    return sorted(touched, key=repr)


def export_plan(records: DataFrame, step: str, labels: Sequence[str], folder: str) -> DataFrame:
    """``(record_id, label, source, target)`` of exported path labels: ``folder/base.STEP.ext`` for each path."""
    require_labels(records, step, labels)
    entries = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{step}`.`{x}`").alias("source")) for x in labels])
    rows = records.where(F.col(f"`{step}_ran`")).select(KEY, F.inline(entries)).where(F.col("source").isNotNull())
    return rows.withColumn("target", exported_path("source", step, folder))


def exported_path(path: str | Column, step: str, folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), export_name(path, step))


def copy_files(plan: DataFrame) -> DataFrame:
    """Copy ``source`` to ``target`` in the tasks; ``(record_id, label, target, bytes)`` of the copies.

    A copy is written beside its target and renamed, so a repeated task is harmless.
    """
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_copy(s, t) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64())],
                                             names=[KEY, "label", "target", "bytes"])

    return plan.select(KEY, "label", "source", "target").mapInArrow(copy, f"{KEY} string, label string, target string, bytes long")


def _copy(source: str, target: str) -> int:
    from_fs, from_path = fs.FileSystem.from_uri(source)
    to_fs, to_path = fs.FileSystem.from_uri(target)
    side = f"{to_path}.{uuid.uuid4().hex}"
    to_fs.create_dir(to_path.rpartition("/")[0], recursive=True)
    fs.copy_files(from_path, side, source_filesystem=from_fs, destination_filesystem=to_fs)
    to_fs.move(side, to_path)
    return to_fs.get_file_info(to_path).size
