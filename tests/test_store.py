"""Versions of the results store: whole for every reader, whatever a writer does or leaves undone."""

import pytest

from recordflow.sources import results as results_module
from recordflow.sources import store as store_module
from recordflow.sources.results import latest, load_results, purge_store, read_results, remove_from_store, write_results
from recordflow.sources.store import StoreChanged, open_store, publish, store_versions, vacuum_store, write_batch
from recordflow.storage import Files
from tests.conftest import rows
from tests.oracle_check import plan_of

SCHEMA = "pipeline string, step string, step_no int, record_id string, label string, value string"


def made(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "store")
    write_results(made(spark, ("p", "A", 1, "1", "x", "a1"), ("p", "A", 1, "2", "x", "a2"), ("p", "B", 2, "1", "x", "b1"), ("p", "B", 2, "1", "y", "b2"), ("q", "A", 1, "1", "x", "q")), path)
    return path


def values(spark, path, version=None):
    return [r[0] for r in rows(read_results(spark, path, version), "value")]


def test_readers_see_whole_versions(spark, path):
    before = open_store(spark, path)
    assert write_results(made(spark, ("p", "A", 1, "9", "x", "new")), path, pipeline="p") == 2
    assert [r[0] for r in rows(before.results, "value")] == ["a1", "a2", "b1", "b2", "q"]
    assert values(spark, path) == ["new", "q"] and values(spark, path, 1) == ["a1", "a2", "b1", "b2", "q"]
    assert store_versions(spark, path) == [2, 1]
    with pytest.raises(Exception, match="7"):
        open_store(spark, path, 7)
    assert open_store(spark, path + "-none").results.count() == 0 == open_store(spark, path + "-none").labels.count()


@pytest.mark.parametrize("change", ["write", "remove", "purge"])
def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, path, monkeypatch, change):
    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(results_module, "publish", dies)
    edges = spark.createDataFrame([("A", "B")], "src string, dst string")
    with pytest.raises(KeyboardInterrupt):
        if change == "write":
            write_results(made(spark, ("p", "A", 1, "9", "x", "new")), path, pipeline="p")
        elif change == "remove":
            remove_from_store(spark, path, spark.createDataFrame([("1",)], "record_id string"))
        else:
            purge_store(spark, path, edges, spark.createDataFrame([("A",)], "node string"))
    assert values(spark, path) == ["a1", "a2", "b1", "b2", "q"] and store_versions(spark, path) == [1]


def test_a_version_that_is_not_whole_is_passed_over(spark, path):
    Files(spark, path).at("versions").at(f"{2:012d}.json").create_text('{"partitions": [')
    assert open_store(spark, path).version == 1
    assert write_results(made(spark, ("r", "A", 1, "1", "x", "r")), path) == 3
    assert values(spark, path) == ["a1", "a2", "b1", "b2", "q", "r"]


def test_two_writers_of_one_version(spark, path):
    """The second applies its change to what the first published; a removal from partitions that changed fails."""
    mine, theirs = write_batch(made(spark, ("r", "A", 1, "1", "x", "r")), path), write_batch(made(spark, ("s", "A", 1, "1", "x", "s")), path)
    calls = []

    def change(held):
        if not calls:
            publish(spark, path, lambda now: [*now, *theirs])
        calls.append(len(held))
        return [*held, *mine]

    assert publish(spark, path, change) == 3 and calls == [3, 4]
    assert values(spark, path) == ["a1", "a2", "b1", "b2", "q", "r", "s"]


def test_ids_are_not_removed_from_what_another_writer_replaced(spark, path, monkeypatch):
    real = results_module.write_batch

    def slow(results, where):
        monkeypatch.setattr(results_module, "write_batch", real)
        write_results(made(spark, ("q", "A", 1, "1", "x", "newer")), path)
        return real(results, where)

    monkeypatch.setattr(results_module, "write_batch", slow)
    with pytest.raises(StoreChanged):
        remove_from_store(spark, path, spark.createDataFrame([("1",)], "record_id string"))
    assert values(spark, path) == ["a1", "a2", "b1", "b2", "newer"]


def test_vacuum_keeps_what_the_kept_versions_name(spark, path, tmp_path):
    write_results(made(spark, ("p", "A", 1, "9", "x", "new")), path)
    lost = write_batch(made(spark, ("z", "A", 1, "1", "x", "never")), path)[0].batch
    assert vacuum_store(spark, path, keep=2) == [] and vacuum_store(spark, path, keep=2, older_than=0) == [lost]
    write_results(made(spark, ("p", "A", 1, "9", "x", "newer"), ("p", "B", 1, "9", "x", "b"), ("q", "A", 1, "9", "x", "q2")), path)
    assert len(vacuum_store(spark, path, older_than=0)) == 2
    assert store_versions(spark, path) == [3] and values(spark, path) == ["b", "newer", "q2"]
    with pytest.raises(ValueError):
        vacuum_store(spark, path, keep=0)


def test_names_come_from_the_catalogue(spark, path, monkeypatch):
    """No result row is read for names, one label of one step is a projection, other steps are not read."""
    now = open_store(spark, path)
    assert rows(now.labels) == [("p", "A", 1, "x", 2), ("p", "B", 2, "x", 1), ("p", "B", 2, "y", 1), ("q", "A", 1, "x", 1)]
    read = []
    real = store_module.Snapshot.results.fget
    monkeypatch.setattr(store_module.Snapshot, "results", property(lambda self: (read.append(1), real(self))[1]))
    one = load_results(now, {"p": {"v": "y"}})
    plan = plan_of(one)
    assert read == [1] and "Aggregate" not in plan and "Exchange" not in plan and "B" in plan.partition("PartitionFilters")[2]
    assert rows(one) == [("1", "b2")]
    assert rows(load_results(now, {"p": "x"})) == [("1", "b1"), ("2", "a2")]
    assert rows(load_results(now, {"p": "all", "q": {"x": "x"}})) == [("1", "q", "b2"), ("2", "a2", None)]
    with pytest.raises(results_module.ImproperInput):
        load_results(now, {"p": "z"})


def test_latest_passes_labels_of_one_step_on(spark, path):
    now = open_store(spark, path)
    assert rows(latest(now)) == rows(latest(now.results))
    alone = write_results(made(spark, ("q", "A", 1, "1", "x", "q"), ("q", "B", 1, "1", "y", "r")), path + "-2")
    assert "Aggregate" not in plan_of(latest(open_store(spark, path + "-2", alone)))
