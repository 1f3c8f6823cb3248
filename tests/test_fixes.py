"""Stored results after changes, exact values in Python functions, single runs, whole copies."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordflow.operators.checks import check_outputs, missing_outputs, temp_files
from recordflow.operators.lookup import layered_lookup
from recordflow.operators.records import KEY
from recordflow.operators.runlog import logged_step, run_log, run_once, split_errors
from recordflow.operators.steps import has_run, map_step, map_step_py
from recordflow.sources.files import files_to_records, stage_input
from recordflow.sources.loader import load_records
from recordflow.sources.results import (
    ImproperInput, copy_files, export_plan, export_steps, load_results, purge_store, read_results, remove_from_store, write_results,
)
from recordflow.sources.sequences import read_label
from recordflow.sources.store import open_store
from recordflow.storage import cut, release, run_dir
from recordflow.streaming.incremental import run_incremental
from tests.conftest import rows

SCHEMA = "pipeline string, step string, step_no int, record_id string, label string, value string"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    data = [("p", s, 1, str(i), "x", f"{s}{i}") for s in ("A", "B", "C:1") for i in range(3)] + [("q", "B", 1, "1", "x", "other")]
    write_results(spark.createDataFrame(data, SCHEMA), path)
    return path


def left(spark, path):
    return rows(read_results(spark, path), "pipeline", "step", "record_id")


def test_a_rerun_drops_steps_without_rows(spark, store):
    again = spark.createDataFrame([("p", "A", 1, "9", "x", "new")], SCHEMA)
    write_results(again, store, pipeline="p", steps=["A", "B"])
    assert left(spark, store) == [("p", "A", "9")] + [("p", "C:1", str(i)) for i in range(3)] + [("q", "B", "1")]
    write_results(again, store, pipeline="p")
    assert left(spark, store) == [("p", "A", "9"), ("q", "B", "1")]


def test_purged_steps_are_gone(spark, store):
    edges = spark.createDataFrame([("B", "C:1", "requires")], "src string, dst string, kind string")
    gone = purge_store(spark, store, edges, spark.createDataFrame([("B",)], "node string"))
    assert sorted(gone) == [("p", "B"), ("p", "C:1"), ("q", "B")]
    assert left(spark, store) == [("p", "A", str(i)) for i in range(3)]


def test_removed_ids_leave_no_empty_partition(spark, store, tmp_path):
    touched = remove_from_store(spark, store, spark.createDataFrame([("1",), ("unknown",)], "record_id string"))
    assert sorted(touched) == [("p", "A"), ("p", "B"), ("p", "C:1"), ("q", "B")]
    assert left(spark, store) == [("p", s, i) for s in ("A", "B", "C:1") for i in ("0", "2")]
    assert ("q", "B") not in {p.key for p in open_store(spark, store).partitions}
    assert remove_from_store(spark, store, spark.createDataFrame([("1",)], "record_id string")) == []
    assert [p.name for p in tmp_path.iterdir()] == ["store"]


def test_any_number_of_labels(spark):
    many = spark.range(10_001).select(
        F.lit("p").alias("pipeline"), F.lit("A").alias("step"), F.lit(1).alias("step_no"), F.lit("1").alias(KEY),
        F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"), F.col("id").cast("string").alias("value"))
    assert rows(load_results(many, {"p": "l5"})) == [("1", "5")]
    with pytest.raises(ImproperInput, match="no results for l10001"):
        load_results(many, {"p": "l10001"})
    with pytest.raises(ImproperInput, match="no results of r"):
        load_results(many, {"r": "l1"})


def test_exported_files_are_copied_by_tasks(spark, tmp_path):
    (tmp_path / "a.b.txt").write_text("content")
    records = spark.createDataFrame([("1", str(tmp_path / "a.b.txt")), ("2", None)], "record_id string, p string")
    stepped = map_step(records, "Write", run={"path": F.col("p")}, condition=F.col("p").isNotNull())
    folder = str(tmp_path / "out")
    assert rows(copy_files(export_plan(stepped, "Write", ["path"], folder))) == [("1", "path", f"{folder}/a.b.Write.txt", 7)]
    exported = export_steps(stepped, {"Write": ["path"]}, "run", path_labels=["path"], folder=folder)
    assert rows(exported, "value") == [(f"{folder}/a.b.Write.txt",)]
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["a.b.Write.txt"]


BIG = 9007199254740993


def numbers(spark):
    return spark.createDataFrame([("1", 1, True), ("2", None, None), ("3", BIG, False)], "record_id string, q long, b boolean").coalesce(1)


def test_python_functions_see_exact_values(spark):
    seen = logged_step(numbers(spark), "S", lambda v: {"r": repr((v["q"], v["b"]))}, "r string", ["q", "b"])
    assert rows(seen, "S.r") == [("(1, True)",), (f"({BIG}, False)",), ("(None, None)",)]
    stepped = map_step_py(numbers(spark), "S", lambda b: pd.DataFrame({"r": b["q"], "n": ~b["b"]}), "r long, n boolean", ["q", "b"], condition=F.col("record_id") != "1")
    assert rows(stepped, "record_id", "S.r", "S.n") == [("1", None, None), ("2", None, None), ("3", BIG, True)]
    loaded = load_records(numbers(spark), lambda p: [{KEY: None if p["q"] is None else p["q"], "v": p["q"]}], "record_id string, v long")
    assert rows(loaded) == [(str(1), 1), (str(BIG), BIG), (None, None)]


def test_records_of_one_batch_are_independent_in_timestamps(spark):
    stamped = numbers(spark).withColumn("t", F.when(F.col("q").isNotNull(), F.timestamp_millis(F.lit(1000))))
    stepped = map_step_py(stamped, "S", lambda b: pd.DataFrame({"s": b["t"].astype(str)}), "s string", ["t"])
    assert rows(stepped, "record_id", "S.s")[0] == ("1", "1970-01-01 00:00:01")


def test_the_function_runs_once_for_good_bad_and_log(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def half(values):
        with open(calls, "a") as f:
            f.write(".")
        if values["v"] % 2:
            raise ValueError("odd")
        return {"h": values["v"] // 2}

    records = spark.createDataFrame([(str(i), i) for i in range(10)], "record_id string, v long")
    stepped = run_once(logged_step(records, "S", half, "h long", ["v"], mode="quarantine"), "S")
    good, bad = split_errors(stepped, "S")
    assert good.count() == 5 and bad.count() == 5 and run_log(stepped, "S").count() == 10
    with open(calls) as f:
        assert len(f.read()) == 10


def test_outputs_of_skipped_records_are_not_missed(spark):
    records = spark.createDataFrame([("1", True), ("2", False)], "record_id string, go boolean")
    stepped = map_step(records, "W", declare={"path": F.concat(F.lit("/w/"), F.col(KEY))}, condition=F.col("go"))
    manifest = spark.createDataFrame([("/w/1",)], "path string")
    paths = {"path": F.col("W.path")}
    assert check_outputs(stepped, "W", paths, manifest).count() == 2
    assert rows(missing_outputs(stepped, "W", paths, manifest.limit(0)), KEY) == [("1",)]
    assert missing_outputs(stepped, "W", paths, manifest.limit(0), condition=F.col(KEY) == "2").count() == 0


def test_a_step_without_labels_has_run(ids10):
    stepped = map_step(ids10, "Touch", condition=F.col(KEY) == "1")
    assert stepped.where(has_run(stepped, "Touch")).count() == 10


def test_done_records_are_not_run_again_and_all_batches_count(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "record_id string, v int"

    def steps(records):
        return records.select(KEY, F.when(F.col("v") > 100, F.raise_error("ran again").cast("int")).otherwise(F.col("v")).alias("v"))

    for i in range(6):
        spark.createDataFrame([(str(i), i)], schema).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        assert run_incremental(spark, source, schema, steps, out, checkpoint, skip_done=True, max_files=1) == 6
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    spark.createDataFrame([("3", 300), ("7", 7), ("7", 7)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run_incremental(spark, source, schema, steps, out, checkpoint, skip_done=True) == 3
    assert rows(spark.read.parquet(out)) == [(str(i), i) for i in (0, 1, 2, 3, 4, 5, 7)]


def test_a_broken_copy_is_made_anew(spark, tmp_path):
    path = tmp_path / "copy"
    data = spark.range(10)
    path.mkdir()
    assert stage_input(data, str(path)).count() == 10
    (path / "_SUCCESS").unlink()
    next(p for p in path.iterdir() if p.name.startswith("part-")).unlink()
    assert stage_input(data, str(path)).count() == 10
    assert stage_input(spark.range(3), str(path)).count() == 10


def test_file_names_give_the_same_ids_everywhere(spark, tmp_path):
    names = ["a+b.fasta", "c%d.fasta", "e f.fasta", "g%2Bh.fasta"]
    for n in names:
        (tmp_path / n).write_text(">s\nACGT\n")
    manifest = spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
    by_name = sorted(r[KEY] for r in files_to_records(manifest).collect())
    assert sorted(r[KEY] for r in read_label(spark, str(tmp_path), "fasta").collect()) == by_name == sorted(n[:-6] for n in names)


def test_matches_and_survivors_are_complements(spark):
    manifest = spark.createDataFrame([("1", "a.part"), ("1", "keep.txt")], "record_id string, path string")
    assert rows(temp_files(manifest, ["*.part"])) == [("1", "a.part")]


def test_lookup_computes_its_tables_once(spark):
    records = spark.createDataFrame([("1", "k", "g")], "record_id string, k string, g string")
    own = spark.createDataFrame([("k", 1)], "k string, v int")
    fallback = spark.createDataFrame([("g", 2)], "g string, v int")
    assert rows(layered_lookup(records, own, "k", fallback, "g", "v")) == [("1", "k", "g", 1)]


def test_intermediate_tables_can_be_released(spark):
    from recordflow.storage import Files

    cut(spark.range(3), "kept")
    assert Files(spark, run_dir(spark)).exists()
    release(spark)
    assert not Files(spark, run_dir(spark)).exists()
