"""A user's loader hears which records and labels are wanted, and plans its own pieces."""

import pytest

from recordflow.sources.user_source import PUSHDOWN, load_source
from tests.conftest import rows
from tests.oracle_check import plan_of


class Letters:
    """A piece for each shard; notes what it is asked for."""

    schema = "record_id string, n long, name string"

    def __init__(self, log):
        self.log = log

    def plan(self, keys):
        return [s for s in range(3) if keys is None or any(int(k) % 3 == s for k in keys)]

    def load(self, piece, keys, labels):
        with open(self.log, "a") as f:
            f.write(f"{piece} {sorted(keys) if keys is not None else None} {labels}\n")
        for i in range(piece, 10, 3):
            yield {"record_id": None if i == 9 else i, "n": i * i, **({"name": f"r{i}"} if i % 2 else {})}


@pytest.fixture
def log(tmp_path):
    return tmp_path / "log"


def test_all_records(spark, log):
    got = load_source(spark, Letters(str(log)))
    want = [(str(i) if i < 9 else None, i * i, f"r{i}" if i % 2 else None) for i in range(10)]
    assert rows(got) == sorted(want, key=repr) and plan_of(got).count("Scan") == 1
    assert len(log.read_text().splitlines()) == 3


def test_keys_and_labels_reach_the_loader(spark, log):
    got = load_source(spark, Letters(str(log)), labels=["n"], keys=[4, "7", "x0"[1:]])
    assert got.columns == ["record_id", "n"] and rows(got) == [("0", 0), ("4", 16), ("7", 49)]
    assert sorted(set(log.read_text().splitlines())) == ["0 ['0', '4', '7'] ['n']", "1 ['0', '4', '7'] ['n']"]
    with pytest.raises(ValueError, match="no labels"):
        load_source(spark, Letters(str(log)), labels=["other"])


@pytest.mark.parametrize("condition", ["record_id = '4'", "record_id IN ('4', '5') AND n < 20"])
def test_a_filter_on_the_key_reaches_the_loader(spark, log, condition):
    spark.conf.set(PUSHDOWN, "true")
    try:
        assert rows(load_source(spark, Letters(str(log))).where(condition), "record_id", "n") == [("4", 16)]
    finally:
        spark.conf.unset(PUSHDOWN)
    asked = log.read_text()
    assert "None" not in asked and not asked.startswith("0 ")
    assert rows(load_source(spark, Letters(str(log))).where(condition), "record_id", "n") == [("4", 16)]


def test_a_schema_needs_the_key(spark, log):
    loader = Letters(str(log))
    loader.schema = "n long"
    with pytest.raises(ValueError, match="record_id"):
        load_source(spark, loader)
