import pytest
from pyspark.sql import functions as F

from recordflow.operators.records import MissingLabel, keyed_records, merge_records
from recordflow.operators.steps import map_step
from recordflow.sources.results import (
    ImproperInput,
    export_results,
    export_steps,
    latest,
    load_results,
    purge_steps,
    read_results,
    remove_ids,
    write_results,
)
from recordflow.streaming.incremental import run_incremental
from tests.conftest import rows


def test_three_chained_pipelines(spark, ids10, tmp_path):
    store = str(tmp_path / "results")
    first = map_step(ids10, "Write", run={"write-result": F.concat(F.lit("w"), "record_id")})
    first = map_step(first, "Update", run={"update-result": F.concat(F.col("Write.`write-result`"), F.lit("a"))})
    write_results(export_steps(first, {"Write": ["write-result"], "Update": ["update-result"]}, "first_pipeline"), store)

    loader = spark.createDataFrame([(str(i), chr(65 + i)) for i in range(10)], "record_id string, value string")
    loaded = load_results(read_results(spark, store), {"first_pipeline": {"input": "update-result"}})
    second = merge_records(loader, loaded)
    second = map_step(second, "Print", run={"output": F.concat_ws(":", "value", "input")})
    write_results(export_results(second, "Print", ["output"], "second_pipeline", 1), store)

    spec = {"first_pipeline": "update-result", "second_pipeline": ["output", {"new_output": "output"}]}
    third = load_results(read_results(spark, store), spec)
    third = map_step(third, "Combine", run={"out_file": F.concat_ws("|", "`update-result`", "output", "new_output")})
    got = rows(export_results(third, "Combine", ["out_file"], "third_pipeline", 1), "record_id", "value")
    assert got == [(str(i), f"w{i}a|{chr(65 + i)}:w{i}a|{chr(65 + i)}:w{i}a") for i in range(10)]
    everything = load_results(read_results(spark, store), {"first_pipeline": "all"})
    assert sorted(everything.columns) == ["record_id", "update-result", "write-result"]


@pytest.fixture
def results(spark):
    return spark.createDataFrame(
        [
            ("p", "A", 1, "1", "x", "old"), ("p", "B", 2, "1", "x", "new"), ("p", "A", 1, "2", "x", "only"),
            ("p", "A", 1, "2", "y", "why"), ("q", "A", 1, "1", "x", "other"), ("q", "A", 1, "3", "z", "zed"),
        ],
        "pipeline string, step string, step_no int, record_id string, label string, value string",
    )


def test_latest_step_wins(results):
    assert rows(latest(results.where("pipeline = 'p'")), "record_id", "label", "value") == [
        ("1", "x", "new"), ("2", "x", "only"), ("2", "y", "why")
    ]


def test_later_request_wins_where_it_has_a_value(results):
    assert rows(load_results(results, {"p": {"v": "x"}, "q": {"v": "x"}})) == [("1", "other"), ("2", "only")]
    assert rows(load_results(results, {"q": {"v": "x"}, "p": {"v": "x"}})) == [("1", "new"), ("2", "only")]
    assert rows(load_results(results, {"p": ["y", {"v": "x"}]})) == [("1", None, "new"), ("2", "why", "only")]


def test_ids_without_exports_can_be_kept(spark, results):
    ids = spark.createDataFrame([("1",), ("9",)], "record_id string")
    assert rows(load_results(results, {"q": "all"}, ids=ids)) == sorted(
        [("1", "other", None), ("9", None, None), ("3", None, "zed")], key=repr
    )


@pytest.mark.parametrize("spec", [{"r": "all"}, {"p": "nope"}, {"p": {"v": "nope"}}, {"p": ["x", 3]}, {"p": 3}])
def test_improper_requests(results, spec):
    with pytest.raises(ImproperInput):
        load_results(results, spec)


def test_export_only_where_it_ran_and_never_null(ids10):
    stepped = map_step(ids10, "S", declare={"d": F.lit(1)}, run={"x": F.col("record_id")}, condition=F.col("record_id") < "2")
    assert rows(export_results(stepped, "S", ["d", "x"], "p", 4)) == [
        ("p", "S", 4, "0", "d", "1"), ("p", "S", 4, "0", "x", "0"), ("p", "S", 4, "1", "d", "1"), ("p", "S", 4, "1", "x", "1")
    ]
    broken = map_step(ids10, "S", run={"x": F.lit(None).cast("string")})
    with pytest.raises(Exception, match="no value to export"):
        export_results(broken, "S", ["x"], "p", 1).count()
    with pytest.raises(MissingLabel):
        export_results(stepped, "S", ["zz"], "p", 1)


def test_a_step_is_replaced_alone_in_the_store(spark, results, tmp_path):
    path = str(tmp_path / "store")
    write_results(results, path)
    write_results(results.where("pipeline = 'p' AND step = 'B'").withColumn("value", F.lit("newer")), path)
    got = read_results(spark, path)
    assert got.count() == 6
    assert rows(got.where("step = 'B'"), "value") == [("newer",)]


def test_remove_ids(spark, ids10, results):
    ids = spark.createDataFrame([("1",), ("unknown",)], "record_id string")
    left = remove_ids([ids10, results], ids)
    assert left[0].count() == 9 and rows(left[1], "record_id") == [("2",), ("2",), ("3",)]


def test_purge_follows_requirements(spark, results):
    edges = spark.createDataFrame([("A", "B", "requires"), ("B", "C", "depends")], "src string, dst string, kind string")
    seed = spark.createDataFrame([("B",)], "node string")
    assert rows(purge_steps(results, edges, seed), "step") == [("A",)] * 5
    assert purge_steps(results, edges, spark.createDataFrame([("A",)], "node string")).count() == 0


def test_incremental_run_takes_only_new_files(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "record_id string, v int"

    def steps(records):
        return map_step(records, "S", run={"twice": F.col("v") * 2}).select("record_id", "S.twice")

    spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], schema).write.parquet(source)
    assert run_incremental(spark, source, schema, steps, out, checkpoint) == 3
    spark.createDataFrame([("4", 4), ("5", 5)], schema).write.mode("append").parquet(source)
    assert run_incremental(spark, source, schema, steps, out, checkpoint) == 2
    assert run_incremental(spark, source, schema, steps, out, checkpoint) == 0
    assert rows(spark.read.parquet(out)) == [(str(i), 2 * i) for i in range(1, 6)]


def test_incremental_run_skips_known_ids(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "record_id string, v int"

    def steps(records):
        return keyed_records(records, "record_id", ["v"])

    for drop in ([("1", 1), ("2", 2)], [("2", 20), ("3", 3), ("3", 3)]):
        spark.createDataFrame(drop, schema).write.mode("append").parquet(source)
        run_incremental(spark, source, schema, steps, out, checkpoint, skip_done=True)
    assert rows(spark.read.parquet(out)) == [("1", 1), ("2", 2), ("3", 3)]
