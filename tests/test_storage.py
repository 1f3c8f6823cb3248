from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recordflow.storage import broadcast_if_small, cut, cut_counted, scratch_path, shared_dir
from tests.conftest import rows
from tests.oracle_check import plan_of


class FakeContext:
    def __init__(self, master, configured=None):
        self.master, self.configured = master, configured

    def getCheckpointDir(self):
        return self.configured

    def setCheckpointDir(self, path):
        self.configured = path


def fake(master, conf=None, configured=None):
    values = {"spark.checkpoint.dir": conf} if conf else {}
    return SimpleNamespace(sparkContext=FakeContext(master, configured), conf=SimpleNamespace(get=lambda k, d=None: values.get(k, d)))


def test_the_sessions_checkpoint_folder_is_used():
    session = fake("yarn", conf="hdfs://nn/shared/")
    assert shared_dir(session) == "hdfs://nn/shared"
    assert session.sparkContext.configured == "hdfs://nn/shared/"
    assert shared_dir(fake("yarn", configured="hdfs://nn/set")) == "hdfs://nn/set"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077"))
    local = fake("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_scratch_paths_are_new(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_cut_keeps_rows_and_counts(spark, ids10):
    table, counts = cut_counted(ids10, scratch_path(spark, "t"), low=F.count_if(F.col("record_id") < "3"))
    assert rows(table) == rows(ids10) and counts == {"n": 10, "low": 3}
    assert cut_counted(ids10.where("false"), scratch_path(spark, "t"))[1] == {"n": 0}
    assert cut(ids10).columns == ["record_id"]


def test_broadcast_only_when_measured_small(spark, ids10):
    nested = ids10.select("record_id", F.lit(1).alias("n"), F.array(F.lit("x"), F.lit("y")).alias("a"), F.lit(None).cast("string").alias("s"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ids10.join(broadcast_if_small(nested), "record_id", "left")
        assert "BroadcastHashJoin" in plan_of(joined)
        joined = ids10.join(broadcast_if_small(nested, max_bytes=100), "record_id", "left")
        assert "SortMergeJoin" in plan_of(joined)
        assert joined.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert broadcast_if_small(ids10.where("false")).count() == 0
