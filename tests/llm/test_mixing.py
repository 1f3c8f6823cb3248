"""The mix of sources: targets, caps, order, edge cases."""

import re

import pytest

from recordflow.llm import mixing
from recordflow.llm.mixing import mix
from tests.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    budget, capped, level = sum(sizes.values()), set(), 0.0
    while len(capped) < len(order):
        level = (budget - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if level * weight[s] >= 3 * sizes[s]}
        if new == capped:
            break
        capped = new
    return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}


@pytest.mark.parametrize("least_bucket", [4096, 3])
def test_taken_words_follow_the_targets(spark, monkeypatch, least_bucket):
    monkeypatch.setattr(mixing, "LEAST_BUCKET", least_bucket)
    data, sizes = [], {}
    for i, (source, n) in enumerate([("a", 400), ("b", 30), ("é", 80), ("z", 3), (None, 50)]):
        for k in range(n):
            words = 1 + (k * 7 + i) % 9
            data.append((1000 * i + k, source, " ".join(["w"] * words)))
            sizes[source] = sizes.get(source, 0) + words
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    result = mix(docs).collect()
    assert mix(docs).columns == ["doc_id", "source", "text", "size", "source_size", "target", "taken"]
    want, taken = expected_targets(sizes), {}
    for r in result:
        assert r["size"] == len(WORD.findall(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 5
    # Repeats come only once a source is used up, and at most one document of a source is taken in part in a repeat.
    for source in sizes:
        mine = [r for r in result if r["source"] == source]
        assert sum(r["taken"] % r["size"] > 0 for r in mine) <= 2
        full = taken[source] // sizes[source]
        assert all(r["taken"] >= full * r["size"] - r["size"] for r in mine)
    assert sum(taken.values()) <= sum(sizes.values())
    again = {r["doc_id"]: r["taken"] for r in mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in result}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, None, 9), (2, "a", "", 9), (None, "a", "x y", 9), (3, "b", " \t", 9), (1, "a", "x", 9), (1, "a", "x", 9), (4, None, "q " * 100000, 9)],
        "doc_id long, source string, text string, taken int")
    result = mix(docs)
    assert result.count() == 7 and result.columns.count("taken") == 1
    assert {(r["doc_id"], r["size"]) for r in result.collect()} == {(1, 0), (2, 0), (None, 2), (3, 0), (1, 1), (4, 100000)}
    assert all(r["taken"] == 0 for r in result.collect() if r["size"] == 0)
    assert mix(docs.limit(0)).count() == 0
    assert [tuple(r) for r in mix(docs.where("text is null or trim(text) = ''")).select("target", "taken").distinct().collect()] == [(0.0, 0)]


def test_many_sources_are_ranked_in_code_point_order(spark):
    data = [(i, f"s{i:03d}", "a b c") for i in range(300)]
    got = dict(rows(mix(spark.createDataFrame(data, "doc_id long, source string, text string")).select("source", "target").distinct()))
    want = expected_targets({f"s{i:03d}": 3 for i in range(300)})
    assert got == pytest.approx(want)


def test_a_source_of_one_long_document_is_taken_in_part(spark):
    docs = spark.createDataFrame([(i, "a", "w " * 50) for i in range(4)] + [(9, "b", "w " * 5000)], "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in mix(docs).collect()}
    assert got[9][0] == pytest.approx(4600) and got[9][1] == 4600 and all(got[i][1] == 150 for i in range(4))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    """The query itself: sizes and targets exactly, every source within a word or so of its target."""
    import __spark_entry__ as entry_module

    path = f"/root/testdata/{sf}"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    by_source = {}
    for i, r in docs.items():
        by_source[r["source"]] = by_source.get(r["source"], 0) + size[i]
    want, taken = expected_targets(by_source), dict.fromkeys(by_source, 0)
    got = entry_module.queries()["op3_mix_sources"](spark, path).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by_source[source]) and r["target"] == pytest.approx(want[source])
        assert r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(50, 0.01 * want[s]) for s in want)
    assert abs(sum(taken.values()) - sum(size.values())) <= 2 * len(want)
