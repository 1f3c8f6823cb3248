"""The n-gram join against all pairs."""

import random
import re

import pytest

from recordflow.llm import ngram_join
from recordflow.llm.components import components
from recordflow.llm.ngram_join import keep_first, near_duplicates
from recordflow.storage import cut
from tests.oracle_check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(k)
    least = {k: min(sets[m][0] for m in members) for members in groups.values() for k in members}
    return sorted((i, len(s), least[k]) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def generated(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(60)]
    rows, bases = [], [[word() for _ in range(rng.randrange(5, 90))] for _ in range(6)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            words = list(rng.choice(bases))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
        elif kind < 0.8:
            words = shared + [word() for _ in range(rng.randrange(40))]
        else:
            words = [word() for _ in range(rng.randrange(8))]
        rows.append((1000 - i, " ".join(words)))
    return rows


@pytest.mark.parametrize("stream_rows", [2000, 2])
def test_links_of_generated_groups(spark, monkeypatch, stream_rows):
    """Once with sorted streams alone, once with almost every bucket by aggregates and joins."""
    monkeypatch.setattr(ngram_join, "STREAM_ROWS", stream_rows)
    monkeypatch.setattr(ngram_join, "STREAM_TIMES_MEAN", 0)
    rows = generated(stream_rows)
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(spark):
    base = " ".join(f"a{i}" for i in range(40))
    rows = [(9, base), (9, base), (4, base.upper()), (7, None), (8, ""), (6, " \t\n"), (3, "one"), (2, "ONE"), (1, "one two"),
            (None, base), (None, "alone words here"), (5, base + " z"), (11, base + " z"), (12, " ".join(f"L{i}" for i in range(50000)))]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, node string")
    result = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert {(9, 36, 4), (4, 36, 4), (5, 37, 4), (11, 37, 4), (3, 1, 2), (2, 1, 2), (1, 1, 1), (7, 0, 7), (8, 0, 8), (6, 0, 6),
            (12, 49996, 12), (None, 36, 4), (None, 1, None)} == result
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([4, 7, 8, 6, 2, 1, 12, None, None], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_first(docs.limit(0)).count() == 0


def test_repeated_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "b c"), (1, "b c"), (1, "a"), (2, "q")], "doc_id long, text string")
    assert got(keep_first(docs)) == [(1, "a"), (2, "q")]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}


def test_a_round_of_components_is_few_tasks(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(101, 159)]
    table = cut(spark.createDataFrame(edges, "u long, v long").coalesce(1))
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("tasks-of-components", "")
    try:
        found = components(table)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r["u"]: r["v"] for r in found.collect()} == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("tasks-of-components") for s in seen.getJobInfo(j).stageIds}
    tasks = sum(seen.getStageInfo(s).numCompletedTasks for s in stages if seen.getStageInfo(s))
    assert 0 < tasks < 1000, tasks


def test_later_links_are_joined_between_classes_only(spark, monkeypatch):
    calls = []

    def recorded(edges):
        found = components(edges)
        calls.append(([tuple(r) for r in edges.select("u", "v").collect()], {r["u"]: r["v"] for r in found.collect()}))
        return found

    monkeypatch.setattr(ngram_join, "components", recorded)
    # Every shingle of a base is a document too, and leads its bucket: near copies meet one another only beside it.
    texts = []
    for b in range(4):
        base = [f"b{b}w{k}" for k in range(28)]
        texts += [" ".join(base[k : k + 5]) for k in range(24)]
        texts += [" ".join([*base[:27], f"b{b}own{k}"]) for k in range(4)]
        # These two share words of their own, which join them at once.
        texts += [" ".join([*base[:26], f"b{b}pair", f"b{b}pair", *[f"b{b}odd{k}"] * k]) for k in range(2)]
    rows = [(len(texts) - k, t) for k, t in enumerate(texts)]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert calls[0][1] and any(found for _, found in calls[1:])
    of = {}
    for edges, found in calls:
        assert all(u not in of and v not in of for u, v in edges)
        of |= found


def test_query_agrees_with_its_sql(spark):
    assert compare(spark, oracle_connection(SF_DIR), "op6_ngram_join", SF_DIR) == []
