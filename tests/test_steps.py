import pytest
from pyspark.sql import functions as F

from recordflow.operators.records import MissingLabel
from recordflow.operators.runlog import logged_step, run_log, split_errors
from recordflow.operators.sets import keep_where
from recordflow.operators.steps import (
    Dependency,
    bind_inputs,
    did_run,
    has_run,
    map_step,
    map_step_py,
    pipe_step,
    use_step,
)
from tests.conftest import rows

EVEN_SQL = "cast(record_id as int) % 2 = 0"


def test_declared_labels_everywhere_run_labels_where_it_ran(ids10):
    number = F.col("record_id").cast("int")
    stepped = map_step(ids10, "Number", declare={"id": number}, run={"twice": number * 2}, condition=F.expr(EVEN_SQL))
    assert rows(stepped, "record_id", "Number.id", "Number.twice", "Number_ran") == [
        (str(i), i, i * 2 if i % 2 == 0 else None, i % 2 == 0) for i in range(10)
    ]


def test_run_value_overrides_declared(ids10):
    stepped = map_step(ids10, "S", declare={"x": F.lit("declared")}, run={"x": F.lit("run")}, condition=F.expr(EVEN_SQL))
    assert {(int(r[0]) % 2, r[1]) for r in rows(stepped, "record_id", "S.x")} == {(0, "run"), (1, "declared")}


def test_null_condition_means_run(ids10):
    stepped = map_step(ids10, "S", run={"x": F.lit(1)}, condition=F.lit(None).cast("boolean"))
    assert stepped.where("S_ran AND S.x = 1").count() == 10


@pytest.mark.parametrize("setting, runs", [("true", 0), ("TRUE", 0), (True, 0), ("yes", 10), (None, 10), (False, 10)])
def test_static_skip(ids10, setting, runs):
    stepped = map_step(ids10, "S", declare={"d": F.lit(1)}, run={"x": F.lit(1)}, skip=setting)
    assert stepped.where("S_ran").count() == runs
    assert stepped.where("S.d = 1").count() == 10


def test_skip_by_record(spark):
    records = spark.createDataFrame([("1", "True"), ("2", None), ("3", "no")], "record_id string, skip string")
    stepped = map_step(records, "S", run={"x": F.lit(1)}, skip=F.col("skip"))
    assert rows(stepped, "record_id", "S_ran") == [("1", False), ("2", True), ("3", True)]


def test_step_without_labels(ids10):
    stepped = map_step(ids10, "NoOutput")
    assert stepped.columns == ["record_id", "NoOutput_ran"]
    assert stepped.where("NoOutput_ran").count() == 10


def test_rerun_replaces_the_result(ids10):
    stepped = map_step(map_step(ids10, "S", run={"x": F.lit(1)}), "S", run={"x": F.col("S.x") + 1})
    assert stepped.columns == ["record_id", "S", "S_ran"]
    assert stepped.where("S.x = 2").count() == 10


def test_step_and_label_may_not_differ_by_case_alone(input_other):
    with pytest.raises(ValueError, match="case alone"):
        map_step(input_other, "Input", run={"x": F.lit(1)})


def test_has_run_and_did_run(ids10):
    stepped = map_step(ids10, "S", run={"x": F.lit(1)}, condition=F.expr(EVEN_SQL))
    assert stepped.where(has_run(stepped, "S")).count() == 10
    assert stepped.where(did_run(stepped, "S")).count() == 5
    assert stepped.where(has_run(stepped, "Other") | did_run(stepped, "Other")).count() == 0


def test_pandas_step_sees_only_gated_rows_and_inputs(ids10):
    def weights(batch):
        assert list(batch.columns) == ["record_id"]
        assert all(int(x) % 2 == 0 for x in batch["record_id"])
        return batch[[]].assign(weight=[7 * int(x) + 2 for x in batch["record_id"]])

    stepped = map_step_py(ids10.withColumn("v", F.lit(1)), "C", weights, "weight long", ["record_id"], condition=F.expr(EVEN_SQL))
    assert rows(stepped, "record_id", "C.weight") == [(str(i), 7 * i + 2 if i % 2 == 0 else None) for i in range(10)]


def test_pandas_step_must_keep_rows(ids10):
    stepped = map_step_py(ids10, "C", lambda b: b.head(0).assign(x=1)[["x"]], "x long", ["record_id"])
    with pytest.raises(Exception, match="0 rows returned"):
        stepped.collect()


def test_write_sed_update(ids10):
    """The value of one step goes through a command reused as a dependency."""

    def sed(records, gate):
        return pipe_step(records, "Sed", ["sed", "s/$/a/"], F.col("result"), gate=gate)

    stepped = map_step(ids10, "Write", run={"result": F.col("record_id")})
    uses = Dependency(sed, {"Write": ["result"]})
    stepped = map_step(stepped, "Update", run={"result": F.col("Sed.result")}, depends=[uses])
    assert rows(stepped, "record_id", "Sed.result", "Update.result") == [(str(i), f"{i}a", f"{i}a") for i in range(10)]
    assert "result" not in stepped.columns


def test_command_failures(ids10):
    for command, message in [(["false"], "exit 1"), (["head", "-n", "0"], "0 lines returned")]:
        with pytest.raises(Exception, match=message):
            pipe_step(ids10, "P", command, F.col("record_id")).collect()
    with pytest.raises(Exception, match="line break"):
        pipe_step(ids10, "P", ["cat"], F.lit("a\nb")).collect()


def test_command_passes_nulls_and_gated_rows_by(ids10):
    value = F.when(F.col("record_id") < "8", F.col("record_id"))
    stepped = pipe_step(ids10, "P", ["sed", "s/^/x/"], value, condition=F.expr(EVEN_SQL))
    assert rows(stepped, "record_id", "P.result") == [
        (str(i), f"x{i}" if i % 2 == 0 and i < 8 else None) for i in range(10)
    ]


@pytest.fixture
def input_other(ids10):
    return ids10.select("record_id", F.col("record_id").alias("input"), F.lit("other").alias("other"))


def _dependency(records, gate):
    text = F.concat_ws("-", "record_id", F.col("input"), F.lit("dependency"))
    return map_step(records, "Dependency", run={"output": text}, gate=gate)


def test_bound_inputs_stay_inside_the_dependency(input_other):
    uses = Dependency(_dependency, {"root": {"other": "input"}})
    stepped = map_step(input_other, "Third", run={"output": F.col("input")}, depends=[uses])
    assert rows(stepped, "record_id", "input", "Dependency.output", "Third.output") == [
        (str(i), str(i), f"{i}-other-dependency", str(i)) for i in range(10)
    ]


def test_list_form_of_a_binding_reaches_root_labels(input_other):
    view = bind_inputs(map_step(input_other, "A", run={"x": F.lit(7)}), {"A": ["x"], "root": ["other"]}, only=True)
    assert view.columns == ["record_id", "x", "other"]
    assert bind_inputs(input_other, None).columns == input_other.columns


@pytest.mark.parametrize("binding", [{"A": ["y"]}, {"B": ["x"]}, {"root": ["zz"]}, {"other": ["x"]}])
def test_missing_bound_label_fails(input_other, binding):
    with pytest.raises(MissingLabel):
        bind_inputs(map_step(input_other, "A", run={"x": F.lit(7)}), binding)


def test_two_uses_keep_both_results(input_other):
    first = use_step(input_other, _dependency, rename={"Dependency": "Plain"})
    both = use_step(first, _dependency, {"root": {"other": "input"}}, rename={"Dependency": "Bound"})
    assert "Dependency" not in both.columns
    assert rows(both.where("record_id = '1'"), "Plain.output", "Bound.output", "Plain_ran") == [
        ("1-1-dependency", "1-other-dependency", True)
    ]


def test_last_use_wins_without_a_rename(input_other):
    both = use_step(use_step(input_other, _dependency), _dependency, {"root": {"other": "input"}})
    assert rows(both.where("record_id = '1'"), "Dependency.output", "input") == [("1-other-dependency", "1")]


@pytest.mark.parametrize("depth", [1, 4])
def test_only_the_owners_records_reach_the_innermost_step(spark, depth):
    """Each leg adds a letter to the text of the leg below; the lowest cannot take trips of up to 30 km."""
    def leg(k):
        def step(records, gate):
            if k == 0:
                short = F.raise_error("short trip").cast("string")
                return map_step(records, "Leg0", declare={"far": F.col("km")}, run={"text": F.when(F.col("km") > 30, "a").otherwise(short)}, gate=gate)
            text = F.concat(F.col(f"Leg{k - 1}.text"), F.lit("abcdef"[k]))
            return map_step(records, f"Leg{k}", run={"text": text}, depends=[Dependency(leg(k - 1))], gate=gate)

        return step

    trips = spark.createDataFrame([("north", 12), ("south", 31), ("west", 400), ("east", 30)], "record_id string, km int")
    owned = map_step(
        trips, "Trip", run={"all": F.concat_ws("/", F.col(f"Leg{depth - 1}.text"), "record_id")}, condition=F.col("km") > 30, depends=[Dependency(leg(depth - 1))])
    text = "abcdef"[:depth]
    assert rows(owned, "record_id", "Trip.all", "Leg0.far", "Leg0_ran") == [
        ("east", None, 30, False), ("north", None, 12, False), ("south", f"{text}/south", 31, True), ("west", f"{text}/west", 400, True)]


def test_skip_reaches_dependencies(input_other):
    stepped = map_step(input_other, "Owner", run={"x": F.lit(1)}, depends=[Dependency(_dependency)], skip="true")
    assert stepped.where("Dependency_ran OR Owner_ran").count() == 0


def test_keep_where(ids10):
    assert keep_where(ids10, F.expr(EVEN_SQL)).count() == 5
    assert rows(keep_where(ids10, lambda b: b["record_id"] > "6", ["record_id"])) == [("7",), ("8",), ("9",)]


def _refuse_odd(values):
    if int(values["record_id"]) % 2:
        raise ValueError("odd")
    return {"half": int(values["record_id"]) // 2}


def test_errors_are_kept_or_raised(ids10):
    stepped = logged_step(ids10, "H", _refuse_odd, "half int", ["record_id"], mode="quarantine")
    good, bad = split_errors(stepped, "H")
    assert rows(good, "record_id", "H.half") == [(str(i), i // 2) for i in range(0, 10, 2)]
    assert rows(bad, "record_id", "H_log.error") == [(str(i), "ValueError: odd") for i in range(1, 10, 2)]
    with pytest.raises(Exception, match="failed on record"):
        logged_step(ids10, "H", _refuse_odd, "half int", ["record_id"]).collect()


def test_run_log(ids10):
    stepped = logged_step(ids10, "H", _refuse_odd, "half int", ["record_id"], condition=F.col("record_id") < "5", mode="quarantine")
    log = run_log(stepped, "H", "run1")
    assert log.columns == ["pipeline", "step", "record_id", "status", "seconds", "error"]
    assert rows(log.groupBy("status").count()) == [("failed", 2), ("ok", 3), ("skipped", 5)]
    assert log.where("(seconds IS NULL) = (status = 'skipped')").count() == 10
