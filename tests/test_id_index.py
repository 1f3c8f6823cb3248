"""Incremental runs look ids up in buckets; an index that a dying batch left behind is made anew."""

import pytest
from pyspark.sql import functions as F

from recordflow.operators.records import KEY
from recordflow.streaming import id_index
from recordflow.streaming.id_index import IdIndex
from recordflow.streaming.incremental import run_incremental
from tests.conftest import rows
from tests.oracle_check import plan_of

SCHEMA = "record_id string, v int"


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "cp")]


def drop(spark, path, *data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def once(records):
    return records.select(KEY, F.col("v") + 1)


def test_a_batch_reads_its_own_buckets(spark, folders, monkeypatch):
    monkeypatch.setattr(id_index, "IDS_PER_BUCKET", 20)
    source, out, checkpoint = folders
    run = lambda: run_incremental(spark, source, SCHEMA, once, out, checkpoint, skip_done=True)
    for start, stop in ((0, 30), (30, 500)):
        drop(spark, source, *[(str(i), i) for i in range(start, stop)])
        run()
    index = IdIndex(spark, out)
    index.open()
    assert index.meta["ids"] == 500 and index.meta["buckets"] >= 16
    seen = index.done(spark.createDataFrame([("7",)], "record_id string"))
    assert 1 <= seen.count() <= 70 and "bucket" in plan_of(seen).partition("PartitionFilters")[2]
    drop(spark, source, ("7", 70), ("600", 6), (None, 1), (None, 1))
    assert run() == 4
    got = spark.read.parquet(out)
    assert got.count() == 502 and rows(got.where("record_id = '7'")) == [("7", 8)] and got.where("record_id IS NULL").count() == 1


@pytest.mark.parametrize("lost", ["output", "end"])
def test_a_batch_that_dies_is_taken_up_again(spark, folders, monkeypatch, lost):
    source, out, checkpoint = folders
    drop(spark, source, ("1", 1), ("2", 2))
    run_incremental(spark, source, SCHEMA, once, out, checkpoint, skip_done=True)
    drop(spark, source, ("2", 20), ("3", 3))
    dies = lambda *_: F.raise_error("died")
    with monkeypatch.context() as patch:
        if lost == "end":
            patch.setattr(IdIndex, "end", lambda self: 1 / 0)
        with pytest.raises(Exception, match="died|division"):
            run_incremental(spark, source, SCHEMA, once if lost == "end" else lambda r: r.select(KEY, dies().cast("int")), out, checkpoint, skip_done=True)
    run_incremental(spark, source, SCHEMA, once, out, checkpoint, skip_done=True)
    assert rows(spark.read.parquet(out)) == [("1", 2), ("2", 3), ("3", 4)]
    drop(spark, source, ("3", 9), ("4", 4))
    run_incremental(spark, source, SCHEMA, once, out, checkpoint, skip_done=True)
    assert rows(spark.read.parquet(out)) == [("1", 2), ("2", 3), ("3", 4), ("4", 5)]


def test_an_output_without_an_index_gets_one(spark, folders):
    source, out, checkpoint = folders
    drop(spark, out, ("1", 1), ("5", 5))
    drop(spark, source, ("1", 7), ("2", 2))
    run_incremental(spark, source, SCHEMA, lambda r: r, out, checkpoint, skip_done=True)
    assert rows(spark.read.parquet(out)) == [("1", 1), ("2", 2), ("5", 5)]


def test_rows_of_new_ids_are_not_shuffled(spark, folders):
    """Only ids are looked up: the rows of a batch without repeated ids go from the files to the steps."""
    source, out, checkpoint = folders
    plans = []

    def planned(records):
        plans.append(plan_of(records))
        return once(records)

    run = lambda: run_incremental(spark, source, SCHEMA, planned, out, checkpoint, skip_done=True)
    for data, n in (([(str(i), i) for i in range(40)], 40), ([("7", 70), *((str(i), i) for i in range(40, 60))], 21), ([("8", 80), ("9", 90), ("60", 60)], 3)):
        drop(spark, source, *data)
        assert run() == n
    assert len(plans) == 3 and not any("Exchange hashpartitioning" in p or "Aggregate" in p or "InMemoryTableScan" in p for p in plans)
    drop(spark, source, ("61", 1), ("61", 2), ("3", 1), (None, 5), (None, 6))
    assert run() == 5 and "Aggregate" in plans[-1]
    got = spark.read.parquet(out)
    assert rows(got.where("record_id <> '61'")) == sorted(((str(i), i + 1) for i in range(61)), key=repr)
    drop(spark, source)
    assert run() == 0 and spark.read.parquet(out).count() == 63
    assert got.where("record_id = '61'").count() == got.where("record_id IS NULL").count() == 1


def test_an_index_that_grows_is_written_once(spark, folders, monkeypatch):
    """A batch that needs more buckets goes straight into them, with the ids held before."""
    monkeypatch.setattr(id_index, "IDS_PER_BUCKET", 10)
    source, out, checkpoint = folders
    written, real = [], IdIndex._write
    monkeypatch.setattr(IdIndex, "_write", lambda self, ids: (written.append(ids.count()), real(self, ids))[1])
    for start, stop in ((0, 15), (15, 70), (70, 75)):
        drop(spark, source, *[(str(i), i) for i in range(start, stop)])
        run_incremental(spark, source, SCHEMA, once, out, checkpoint, skip_done=True)
    assert written == [15, 70, 5]
    index = IdIndex(spark, out)
    index.open()
    assert index.meta["ids"] == 75 and index.meta["buckets"] == 8 and index.done(range(8)).distinct().count() == 75
