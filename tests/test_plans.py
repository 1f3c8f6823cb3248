"""Plans that must hold at any size, with size-based broadcasts switched off."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle_check import plan_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def no_size_based_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def plan(spark, name):
    return plan_of(entry_module.queries()[name](spark, SF_DIR))


@pytest.mark.parametrize(
    "name",
    ["keyed_records", "map_step", "conditional_step", "use_step_chain", "use_step_rename", "bind_inputs", "export_results",
     "drop_temp", "gather", "concat_content", "keep_where", "fn_prefix", "fn_split_flags", "map_step_py", "pipe_step", "load_records"],
)
def test_row_steps_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "Exchange" not in text and "Join" not in text
    assert text.count("FileScan") == 1


def test_set_values_move_no_records(spark):
    text = plan(spark, "broadcast_set_result")
    assert "Join" not in text and text.count("Exchange SinglePartition") == text.count("Exchange")


def test_take_while_reaches_the_scan(spark):
    assert "LessThan(o_orderkey" in plan(spark, "take_while")


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(spark, "resume_todo")
    assert "text" not in plan(spark, "conditional_step")


def test_distinct_ids_share_the_joins_partitioning(spark):
    assert plan(spark, "keep_ids").count("Exchange") == 2


def test_stored_results_are_pruned_by_partition(spark):
    assert "PartitionFilters: [isnotnull(pipeline" in plan(spark, "results_store")
