import pytest
from pyspark.sql import functions as F

from recordflow.operators.records import (
    InvalidKeys,
    check_keys,
    input_items,
    input_values,
    keyed_records,
    merge_records,
    union_ids,
)
from recordflow.sources.loader import load_records
from tests.conftest import rows


def test_keys_become_text(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k int, v string")
    records = keyed_records(df, "k")
    assert records.dtypes == [("record_id", "string"), ("v", "string")]
    assert rows(records, "record_id") == [(str(i),) for i in range(10)]


def test_labels_can_be_chosen_and_computed(spark):
    df = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    assert rows(keyed_records(df, "k", ["y"])) == [("1", "b")]
    assert rows(keyed_records(df, "k", {"z": F.upper("x")})) == [("1", "A")]


@pytest.fixture
def bad_ids(spark):
    return spark.createDataFrame([("a b", 1), (None, 2), ("x", 3), ("x", 4), ("fine", 5)], "record_id string, v int")


def test_bad_keys_are_split_off(bad_ids):
    good, bad = check_keys(bad_ids)
    assert rows(good) == [("fine", 5)]
    assert rows(bad) == sorted([("a b", "space", 1), (None, "missing", 1), ("x", "duplicate", 2)], key=repr)


def test_bad_keys_can_fail(bad_ids, ids10):
    with pytest.raises(InvalidKeys):
        check_keys(bad_ids, mode="fail")
    assert check_keys(ids10, mode="fail")[0].count() == 10


def test_merge_incoming_wins_unless_null(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "record_id string, x string, y int")
    incoming = spark.createDataFrame([("2", "B", 20), ("3", None, 30), ("1", None, 10)], "record_id string, x string, z int")
    assert rows(merge_records(base, incoming), "record_id", "x", "y", "z") == sorted(
        [("1", "a", 1, 10), ("2", "B", 2, 20), ("3", None, None, 30)], key=repr
    )


def test_union_of_ids(spark, ids10):
    more = spark.createDataFrame([("9",), ("new",), ("new",)], "record_id string")
    assert rows(union_ids(ids10, more)) == sorted([(str(i),) for i in range(10)] + [("new",)])


def test_views(ids10):
    records = ids10.withColumn("v", F.lit(1))
    assert input_values(records).columns == ["v"]
    assert input_items(records).columns == ["record_id", "v"]


def test_custom_loader(spark):
    def load(part):
        for i in range(part["start"], part["start"] + 5):
            yield {"record_id": i, "value": chr(65 + i)} if i % 2 else {"record_id": i}

    parts = spark.createDataFrame([(0,), (5,)], "start int")
    got = load_records(parts, load, "record_id string, value string", batch_rows=2)
    assert rows(got) == [(str(i), chr(65 + i) if i % 2 else None) for i in range(10)]
    with pytest.raises(ValueError):
        load_records(parts, load, "value string")
