"""Deleting files, splitting finished records in one pass, and updates and orders with NULLs or repeats."""

import pytest
from pyspark.sql import functions as F

from recordflow.operators.checks import delete_files, delete_temp, split_complete
from recordflow.operators.sets import attach, take_while
from recordflow.sources.files import list_files
from tests.conftest import rows
from tests.oracle_check import plan_of


def test_files_of_matching_globs_are_gone(spark, tmp_path):
    for name in ("7/keep.txt", "7/a.swp", "8/7.swp", "8/b c+%41.swp", "8/sub/x.swp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = list_files(spark, str(tmp_path), recursive=True).select(
        F.regexp_extract("path", r"/(\d)/", 1).alias("record_id"), "path", F.regexp_extract("path", r"/\d/(.*)$", 1).alias("inside"))
    files = files.persist()
    files.count()
    report = delete_temp(files, ["*.swp"], "inside", location="path")
    assert sorted(r["path"].rpartition("/")[2] for r in report.where("deleted").collect()) == ["7.swp", "a.swp", "b c+%41.swp"]
    assert report.where("deleted").count() == 0
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["7/keep.txt", "8/sub/x.swp"]
    files.unpersist()


def test_missing_files_folders_and_nulls_are_not_deleted(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    paths = spark.createDataFrame([(str(tmp_path / "folder"),), (str(tmp_path / "none"),), (None,)], "path string")
    assert rows(delete_files(paths), "deleted") == [(False,)] * 3
    assert (tmp_path / "folder").is_dir()
    assert delete_files(paths.limit(0)).count() == 0


def test_one_pass_splits_records_and_reads_the_manifest_once(spark, ids10, tmp_path):
    ids10.where("record_id < '4'").select(F.concat(F.lit("/out/"), "record_id").alias("path")).write.parquet(str(tmp_path / "manifest"))
    records = ids10.withColumn("out", F.concat(F.lit("/out/"), "record_id"))
    done, todo = split_complete(records, spark.read.parquet(str(tmp_path / "manifest")), ["out"])
    assert rows(done, "record_id") == [(str(i),) for i in range(4)] and rows(todo, "record_id") == [(str(i),) for i in range(4, 10)]
    assert "manifest" not in plan_of(done) + plan_of(todo)


def test_a_repeated_id_of_an_update_fails(spark, ids10):
    once = spark.createDataFrame([("1", 5), ("new", 6), (None, 7), (None, 8)], "record_id string, v int")
    assert attach(ids10, "S", once).count() == 4
    with pytest.raises(Exception, match="repeated id in an update: 1"):
        attach(ids10, "S", once.union(once.where("record_id = '1'"))).collect()


def test_records_without_an_order_key_come_last(spark):
    records = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", None, True), ("d", None, False)], "record_id string, line int, good boolean")
    assert rows(take_while(records, "line", F.col("good")), "record_id") == [("a",), ("b",)]
    assert rows(take_while(records.where("record_id <> 'd'"), "line", F.col("good")), "record_id") == [("a",), ("b",), ("c",)]
    assert rows(take_while(records, "line", F.col("good") & (F.col("line") < 2)), "record_id") == [("a",)]
