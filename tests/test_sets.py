import random

import pytest
from pyspark.sql import functions as F

from recordflow.operators.lookup import layered_lookup
from recordflow.operators.records import InvalidKeys
from recordflow.operators.sets import (
    attach,
    concat_content,
    every_nth,
    gather,
    keep_ids,
    pass_through,
    remap,
    rollup_content,
    set_chain,
    set_manifest,
    set_step,
    take_while,
    with_set_result,
)
from recordflow.operators.steps import map_step
from tests.conftest import rows


def test_every_second_attached(ids10):
    """Every second id of the sorted listing stays, with the set step's value."""
    out = every_nth(ids10, 2, offset=1).withColumn("result", F.lit("merged"))
    kept = attach(ids10.withColumn("v", F.lit(1)), "Merge", out)
    assert rows(kept, "record_id", "v", "Merge.result") == [(str(i), 1, "merged") for i in (1, 3, 5, 7, 9)]


@pytest.mark.parametrize("n, offset", [(1, 0), (3, 2), (7, 0)])
def test_positions_hold_over_many_partitions(spark, n, offset):
    values = [(f"k{random.Random(i).random()}", i % 3) for i in range(500)]
    records = spark.createDataFrame(values, "record_id string, grade int").repartition(9)
    expected = sorted(values, key=lambda v: (v[1], v[0]))[offset::n]
    assert rows(every_nth(records, n, offset, order=["grade"])) == sorted(expected, key=repr)


def test_every_nth_of_an_empty_set(ids10):
    assert every_nth(ids10.where("false"), 2).count() == 0
    with pytest.raises(ValueError):
        every_nth(ids10, 2, offset=2)


def test_attach_drops_and_adds_ids(spark, ids10):
    out = spark.createDataFrame([("1", "x"), ("new", "y")], "record_id string, value string")
    kept = attach(ids10.withColumn("v", F.lit(1)), "S", out)
    assert rows(kept, "record_id", "v", "S.value") == [("1", 1, "x"), ("new", None, "y")]
    assert attach(ids10, "S", out, skip="true").count() == 10


def test_keep_ids_ignores_unknown_and_repeated(spark, ids10):
    ids = spark.createDataFrame([("1",), ("1",), ("zz",)], "record_id string")
    assert rows(keep_ids(ids10, ids)) == [("1",)]
    assert rows(keep_ids(ids10, ids, measured=True)) == [("1",)]


def test_remap_replaces_everything(ids10):
    new = remap(ids10.withColumn("v", F.lit(1)), lambda r: r.select(F.concat(F.lit("n"), "record_id").alias("record_id")))
    assert rows(new) == [(f"n{i}",) for i in range(10)]
    with pytest.raises(InvalidKeys):
        remap(ids10, lambda r: r.select(F.lit("same").alias("record_id")), check=True)
    with pytest.raises(ValueError):
        remap(ids10, lambda r: r.select(F.lit(1).alias("x")))


def test_set_value_to_all(ids10):
    total = set_step(ids10, {"total": F.sum(F.col("record_id").cast("long"))})
    assert rows(with_set_result(ids10, "Sum", total), "record_id", "Sum.total") == [(str(i), 45) for i in range(10)]


def test_set_step_with_a_condition(ids10):
    aggs = {"n": F.count(F.lit(1))}
    assert rows(set_step(ids10, aggs, condition=F.count(F.lit(1)) > 10)) == [(None,)]
    assert rows(set_step(ids10, aggs, condition=F.max("record_id") == "9")) == [(10,)]


def test_set_value_must_be_one_row(ids10):
    with pytest.raises(Exception, match="(?i)more than one row|TOO_MANY_ROWS"):
        with_set_result(ids10, "X", ids10).collect()


def test_set_chain_and_pass_through(ids10):
    number = F.col("record_id").cast("int")
    done = set_chain(
        ids10,
        [
            ("Mean", lambda r: set_step(r, {"mean": F.avg(number)})),
            ("Above", lambda r: set_step(r.where(number > F.col("Mean.mean")), {"n": F.count(F.lit(1))})),
        ],
    )
    assert rows(done, "Mean.mean", "Above.n") == [(4.5, 5)]
    assert pass_through(ids10) is ids10


def test_gather_and_manifest(ids10):
    stepped = map_step(ids10, "S", run={"x": F.concat(F.lit("v"), "record_id")}, condition=F.col("record_id") < "3")
    assert rows(gather(stepped, "S", "x", only_ran=True)) == [("0", "v0"), ("1", "v1"), ("2", "v2")]
    assert gather(stepped, "S", "x").count() == 10
    assert rows(set_manifest(ids10, F.lit("a")))[0] == ("0\ta",)


def test_content(spark):
    records = spark.createDataFrame([("a", ["ACTG", "AC"]), ("b", [])], "record_id string, seqs array<string>")
    content = concat_content(records, F.col("seqs"))
    assert rows(content) == [("a:0", "a", 0, "ACTG"), ("a:1", "a", 1, "AC")]
    assert rows(rollup_content(content, seq="item")) == [("a", 2, 6)]


def test_take_while_stops_at_the_first_failure(spark):
    report = spark.createDataFrame(
        [(1, "a", 99.0), (2, "b", 60.0), (3, "c", 59.9), (4, "d", 80.0)], "line int, record_id string, completeness double"
    )
    good = F.col("completeness") >= 60.0
    assert rows(take_while(report, "line", good), "record_id") == [("a",), ("b",)]
    assert take_while(report, "line", F.lit(True)).count() == 4
    assert take_while(report, "line", F.lit(None).cast("boolean")).count() == 0


def test_own_setting_wins_over_the_parents(spark):
    records = spark.createDataFrame([("1", "A", "p"), ("2", "B", "p"), ("3", "B", "q")], "record_id string, scope string, parent string")
    own = spark.createDataFrame([("A", 5)], "scope string, threads int")
    parent = spark.createDataFrame([("p", 2)], "parent string, threads int")
    assert rows(layered_lookup(records, own, "scope", parent, "parent", "threads"), "record_id", "threads") == [
        ("1", 5), ("2", 2), ("3", None)
    ]
