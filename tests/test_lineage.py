import random

import pytest
from pyspark.sql import functions as F

from recordflow.operators.lineage import (
    CyclicLineage,
    cyclic_nodes,
    dependency_chain,
    downstream,
    has_cycle,
    levels,
    mixed_kinds,
    unresolved,
)
from tests.conftest import rows
from tests.oracle_check import plan_of

EDGES = [
    ("A", "B", "requires"), ("B", "C", "requires"), ("B", "D", "requires"), ("B", "E", "requires"),
    ("C", "E", "requires"), ("C", "F", "requires"), ("E", "C", "depends"), ("F", "C", "depends"),
]


def edge_table(spark, edges=EDGES):
    return spark.createDataFrame([(*e, "requires")[:3] for e in edges], "src string, dst string, kind string")


@pytest.mark.parametrize(
    "seed, expected", [("C", "CEF"), ("B", "BCDEF"), ("A", "ABCDEF"), ("D", "D"), ("F", "F"), ("G", "")]
)
def test_downstream(spark, seed, expected):
    seeds = spark.createDataFrame([(seed,)], "node string")
    assert rows(downstream(edge_table(spark), seeds)) == [(n,) for n in expected]


def test_downstream_of_a_dependency(spark):
    seeds = spark.createDataFrame([("E", "C"), ("D", "C")], "node string, dependency string")
    assert rows(downstream(edge_table(spark), seeds)) == [("E",), ("E.C",)]


def test_downstream_knows_given_nodes_and_stands_cycles(spark):
    seeds = spark.createDataFrame([("Z",), ("X",)], "node string")
    nodes = spark.createDataFrame([("Z",), ("X",), ("Y",)], "node string")
    edges = edge_table(spark, [("X", "Y"), ("Y", "X")])
    assert rows(downstream(edges, seeds, nodes)) == [("X",), ("Y",), ("Z",)]


def test_levels(spark):
    assert rows(levels(edge_table(spark))) == [("A", 0), ("B", 1), ("C", 2), ("D", 2), ("E", 3), ("F", 3)]


def test_levels_of_lone_nodes_and_no_edges(spark):
    nodes = spark.createDataFrame([("A",), ("Z",)], "node string")
    assert ("Z", 0) in rows(levels(edge_table(spark), nodes))
    none = edge_table(spark).where("false")
    assert rows(levels(none)) == []
    assert rows(levels(none, nodes)) == [("A", 0), ("Z", 0)]


def test_cycles(spark):
    cyclic = edge_table(spark, [("AB", "BA"), ("BA", "AB"), ("BA", "after"), ("before", "AB")])
    assert has_cycle(cyclic) and not has_cycle(edge_table(spark))
    assert rows(cyclic_nodes(cyclic)) == [("AB",), ("BA",)]
    assert rows(cyclic_nodes(edge_table(spark))) == []
    with pytest.raises(CyclicLineage):
        levels(cyclic)
    with pytest.raises(CyclicLineage):
        dependency_chain(cyclic.select("src", "dst"))


def test_unresolved(spark):
    nodes = spark.createDataFrame([("B",), ("E",)], "node string")
    edges = edge_table(spark, [("A", "B", "requires"), ("E", "C", "depends"), ("B", "E", "requires")])
    assert rows(unresolved(edges, nodes)) == [("B", "A", "requires"), ("E", "C", "depends")]


def test_mixed_kinds(spark):
    nodes = spark.createDataFrame([("row1", "row"), ("row2", "row"), ("set1", "set")], "node string, kind string")
    edges = edge_table(
        spark, [("row1", "set1", "depends"), ("set1", "row2", "depends"), ("row1", "row2", "depends"), ("set1", "row1", "requires")]
    )
    assert rows(mixed_kinds(edges, nodes), "step", "dependency") == [("row1", "set1"), ("set1", "row2")]


def test_dependency_chain_is_ordered_by_the_longest_way(spark):
    chain = edge_table(spark, [("One", "Two", "depends"), ("Two", "Three", "depends"), ("One", "Three", "depends")])
    got = dependency_chain(chain).where("step = 'One'").orderBy(F.desc("depth"))
    assert [tuple(r) for r in got.collect()] == [("One", "Three", 2), ("One", "Two", 1)]


def test_random_graph_against_plain_search(spark):
    """One source holds a third of the edges; many nodes are reached by several ways."""
    rng = random.Random(11)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(120)) if a != b}
    pairs |= {(0, b) for b in range(1, 60)}
    level = {}
    for node in range(60):
        level[node] = max([level[a] + 1 for a, b in pairs if b == node], default=0)
    edges = spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")
    assert rows(levels(edges)) == sorted(((n, v) for n, v in level.items()), key=repr)
    reached, todo = {30}, [30]
    while todo:
        node = todo.pop()
        for a, b in pairs:
            if a == node and b not in reached:
                reached.add(b)
                todo.append(b)
    assert rows(downstream(edges, spark.createDataFrame([(30,)], "node long"))) == sorted(((n,) for n in reached), key=repr)


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_levels_and_cycles_of_chains(spark, length):
    chain = [(i, i + 1) for i in range(length)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    assert rows(levels(edges)) == sorted(((i, i) for i in range(length + 1)), key=repr)
    assert rows(cyclic_nodes(edges)) == []
    ring = spark.createDataFrame(chain + [(length, 0), (length, 99), (98, 0)], "src long, dst long")
    assert rows(cyclic_nodes(ring)) == sorted(((i,) for i in range(length + 1)), key=repr)


@pytest.fixture
def stored(monkeypatch):
    """Rows written by each loop table, in order."""
    from recordflow.operators import lineage

    counts = []
    real = lineage.cut_observed

    def counted(df, path, **kwargs):
        table, found = real(df, path, **{**kwargs, "all_rows": F.count(F.lit(1))})
        counts.append((path.rpartition("/")[0].rpartition("/")[2], found["all_rows"]))
        return table, found

    monkeypatch.setattr(lineage, "cut_observed", counted)
    return counts


def written(stored):
    return sum(n for _, n in stored)


def test_a_long_chain_stores_each_edge_a_few_times(spark, stored):
    """No round writes again what it does not touch."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(0, 40)], "src long, dst long")
    assert {r["node"]: r["level"] for r in levels(edges).collect()} == {i: i for i in range(41)}
    assert written(stored) <= 3 * 41


@pytest.mark.parametrize("bucket_edges", [250_000, 7])
def test_waiting_nodes_are_not_written_again(spark, monkeypatch, stored, bucket_edges):
    """200 nodes wait for both ends of a chain: a round writes what it touches and no more."""
    from recordflow.operators import lineage

    monkeypatch.setattr(lineage, "BUCKET_EDGES", bucket_edges)
    chain = [(i, i + 1) for i in range(20)]
    waiting = [(end, 100 + k) for end in (0, 20) for k in range(200)]
    edges = spark.createDataFrame(chain + waiting, "src long, dst long")
    got = {r["node"]: r["level"] for r in levels(edges).collect()}
    assert got == {**{i: i for i in range(21)}, **{100 + k: 21 for k in range(200)}}
    assert written(stored) <= 3 * len(chain + waiting)


def test_a_round_reads_the_buckets_of_its_frontier(spark, monkeypatch):
    from recordflow.operators import lineage

    monkeypatch.setattr(lineage, "BUCKET_EDGES", 10)
    asked = []
    real = lineage._Layout.of
    monkeypatch.setattr(lineage._Layout, "of", lambda self, buckets: (asked.append(len(set(buckets))), real(self, buckets))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert downstream(edges, spark.createDataFrame([(50,)], "node long")).count() == 11
    assert levels(edges.where("src < 12")).count() == 13
    assert max(asked) == 1
    plan = real(lineage._Layout(edges.toDF("front", "back"), 60, lineage.scratch_path(spark, "t")), [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.partition("PartitionFilters")[2].partition("]")[0]


@pytest.mark.parametrize("growth", [2, 0])
def test_deep_chains_end_in_few_rounds(spark, monkeypatch, stored, growth):
    """1,000 edges in at most 15 rounds; without doubled paths the result is the same."""
    from recordflow.operators import lineage

    monkeypatch.setattr(lineage, "PATH_GROWTH", growth)
    length = 1000 if growth else 12
    edges = spark.createDataFrame([(i, i + 1) for i in range(length)] + [(length, 3), (5, -5), (-7, 0)], "src long, dst long")
    got = downstream(edges, spark.createDataFrame([(0,)], "node long"))
    assert got.count() == got.distinct().count() == length + 2
    assert got.where("node = -7").count() == 0
    rounds = [n for name, n in stored if name == "seen"]
    assert not growth or len(rounds) <= 15


def test_a_pair_of_a_chain_is_written_once(spark, monkeypatch):
    from recordflow.operators import lineage

    kept = []
    real = lineage.cut_counted

    def counted(df, path, **kwargs):
        table, found = real(df, path, **kwargs)
        if "/pairs/level=" in path:
            kept.append(found["n"])
        return table, found

    monkeypatch.setattr(lineage, "cut_counted", counted)
    rng = random.Random(4)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(70)) if a < b})
    longest = {}
    for a in range(29, -1, -1):
        for x, b in pairs:
            if x == a:
                longest[a, b] = max(longest.get((a, b), 0), 1)
                for (c, d), n in list(longest.items()):
                    if c == b:
                        longest[a, d] = max(longest.get((a, d), 0), n + 1)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert rows(dependency_chain(edges)) == sorted(((*k, v) for k, v in longest.items()), key=repr)
    assert sum(kept) == len(longest)
    seeds = spark.createDataFrame([(3,), (9,), (3,)], "node long")
    assert rows(dependency_chain(edges, seeds)) == sorted(((*k, v) for k, v in longest.items() if k[0] in (3, 9)), key=repr)
    assert rows(dependency_chain(edges.limit(0))) == []


def test_chain_of_seeds_only(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"), ("a", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("unknown",)], "node string")
    assert rows(dependency_chain(edges, seeds)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_shortcuts_are_not_followed(spark, monkeypatch):
    """A tree with an edge to each grandparent as well: a pair has one way, which no shuffle has to fold."""
    from recordflow.operators import lineage

    plans = []
    real = lineage.cut_counted

    def planned(df, path, **kwargs):
        if "/pairs/level=" in path:
            plans.append(plan_of(df))
        return real(df, path, **kwargs)

    monkeypatch.setattr(lineage, "cut_counted", planned)
    tree = [(n, n // 2) for n in range(1, 32)] + [(n, n // 4) for n in range(4, 32)]
    expected = sorted(((n, n >> k, k) for n in range(1, 32) for k in range(1, n.bit_length() + 1)), key=repr)
    edges = spark.createDataFrame(tree, "src long, dst long")
    assert rows(dependency_chain(edges)) == expected
    assert plans and not any("HashAggregate" in p or "Exchange hashpartitioning" in p for p in plans)
    monkeypatch.setattr(lineage, "PATH_GROWTH", 0)
    assert rows(dependency_chain(edges)) == expected


@pytest.mark.parametrize("cyclic", [[(a, b) for a in "xyz" for b in "xyz" if a != b], [("x", "x")], [("x", "y"), ("y", "y"), ("y", "z")]])
def test_a_cycle_of_shortcuts_is_a_cycle(spark, cyclic):
    with pytest.raises(CyclicLineage):
        dependency_chain(spark.createDataFrame([("a", "x"), *cyclic], "src string, dst string"))
