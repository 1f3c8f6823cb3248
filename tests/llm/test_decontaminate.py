"""Edit search against brute force, recall, and edge cases."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry_module
from recordflow.llm.decontaminate import ItemIndex, decontaminate, edit_match, find_leaks, search, _masks, _start

SF_DIR = "/root/testdata/sf0.001"


def least(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for symbol in text:
        new = [0]
        for i, w in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (w != symbol)))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pattern = rng.integers(1, 5, rng.integers(1, 90))
        text = rng.integers(0, 5, rng.integers(0, 120)).tolist()
        best, end = edit_match(_masks(pattern), len(pattern), text)
        assert best == min(len(pattern), least(pattern.tolist(), text))
        assert best == len(pattern) or least(pattern.tolist(), text[:end]) == best


def edited(words, k, rng):
    words = list(words)
    for _ in range(k):
        at = int(rng.integers(len(words)))
        kind = rng.integers(3)
        words[at : at + 1] = [["zzz"], [], [words[at], "yyy"]][kind]
    return words


def test_recall_at_the_largest_distance_and_no_chance_hits():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(10, 60)))) for i in range(120)]
    index = ItemIndex(items)
    texts = [" ".join([*rng.choice(vocabulary, 50), *edited(t.split(), index.edits(len(t.split())), rng), *rng.choice(vocabulary, 50)]) for _, t in items]
    found = search(index, pa.array(texts))
    assert np.mean([any(m[0] == i for m in f) for (i, _), f in zip(items, found, strict=True)]) >= 0.95
    for text, matches in zip(texts, found, strict=True):
        words = text.split()
        for item, distance, start, end in matches:
            pattern = items[item][1].split()
            assert least(pattern, words) == distance <= 0.2 * len(pattern)
            assert least(pattern, words[start:end]) == distance


def edited_at(words, k, where, kind, rng):
    """Exactly ``k`` edits of one kind at the head, the tail, evenly or at random words."""
    n = len(words)
    at = {"head": range(k), "tail": range(n - k, n), "even": [j * n // k for j in range(k)], "random": rng.choice(n, k, replace=False)}[where]
    chosen, out = set(map(int, at)), []
    for i, w in enumerate(words):
        out += {"replace": ["zzz"], "drop": [], "insert": ["yyy", w]}[kind] if i in chosen else [w]
    return out


def test_recall_of_long_items_wherever_the_edits_are():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([61, 80, 100, 200, 300, 400, 600] * 5)]
    index = ItemIndex(items)
    for where in ("head", "tail", "even", "random"):
        for kind in ("replace", "drop", "insert"):
            texts = []
            for _, t in items:
                words = t.split()
                texts.append(" ".join([*rng.choice(vocabulary, 40), *edited_at(words, index.edits(len(words)), where, kind, rng), *rng.choice(vocabulary, 40)]))
            found = search(index, pa.array(texts))
            hits = [any(m[0] == i for m in f) for (i, _), f in zip(items, found, strict=True)]
            assert np.mean(hits) >= 0.95, (where, kind)
            assert all(m[1] <= index.edits(len(items[m[0]][1].split())) for f in found for m in f)


def test_edges(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = ["", None, item, f"x {item.upper()}! y", "alpha beta", (item + ". ") * 500, "pad " * 20000 + item, item]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (7, item), (8, ""), (9, None), (None, "x y z"), (10, "§ !")], "item_id long, text string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in find_leaks(docs, items, keep=["doc_id", "item_id"]).collect()}
    assert got == {0: [], 1: [], 2: [7], 3: [7], 4: [], 5: [7], 6: [7], 7: [7]} | {k: v for k, v in got.items() if k < 0}
    assert decontaminate(docs, items).columns == docs.columns
    assert sorted(r["doc_id"] for r in decontaminate(docs, items).collect()) == [0, 1, 4]
    assert decontaminate(docs, items.limit(0)).count() == len(texts)
    assert decontaminate(docs.limit(0), items).count() == 0


def test_many_blocks_find_the_same(spark, monkeypatch):
    from recordflow.llm import decontaminate as module

    docs, items = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    whole = sorted(map(tuple, find_leaks(docs, items, keep=["doc_id"]).collect()))
    monkeypatch.setattr(module, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, find_leaks(docs, items, keep=["doc_id"]).collect())) == whole


def test_query_finds_every_copied_item(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = {r["doc_id"] for r in entry_module.queries()["op1_decontaminate"](spark, SF_DIR).collect()}
    assert got >= {i for i, t in docs.items() if any(x in t for x in items)}


def test_start_of_a_match_against_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 90))
        item = rng.integers(1, 6, n)
        before = item.copy() if rng.random() < 0.5 else rng.integers(1, 6, int(rng.integers(1, 120)))
        before = np.concatenate([rng.integers(1, 6, 5), np.delete(before, rng.integers(0, len(before), 2))])
        rows = [list(range(n + 1))]
        for symbol in before[::-1].tolist():
            row = [rows[-1][0] + 1]
            for i, w in enumerate(item[::-1].tolist(), 1):
                row.append(min(rows[-1][i] + 1, row[i - 1] + 1, rows[-1][i - 1] + (w != symbol)))
            rows.append(row)
        for distance in {r[-1] for r in rows[1:]}:
            assert _start(item, before, distance) == next(j for j, r in enumerate(rows) if j and r[-1] == distance)


@pytest.mark.parametrize("at_once", [1, 4])
def test_many_blocks_of_items(spark, monkeypatch, at_once):
    from recordflow.llm import decontaminate as module

    monkeypatch.setattr(module, "BLOCK_BYTES", 400)
    monkeypatch.setattr(module, "BLOCKS_AT_ONCE", at_once)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(30)]
    docs = [(i, f"some words {text} and more" if i % 2 else "nothing of it", "x") for i, text in items]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string, extra string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: [(m["item_id"], m["distance"], m["start"], m["end"]) for m in r["matches"]] for r in got} == {
        i: [(i, 0, 2, 14)] if i % 2 else [] for i, _ in items}
