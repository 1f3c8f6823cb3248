"""The prefix trie against plain dictionaries, with containers that burst at once, often and never."""

import hashlib
import random

import pytest

import __spark_entry__ as entry_module
from recordflow.llm import prefix_trie as trie_module
from recordflow.llm.prefix_trie import end_digests, numbered_turns, prefix_trie
from tests.oracle_check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def brute(sequences):
    """``{(depth, least member): (parent, members, children, leaves, saved, ends)}`` of ``{conversation: [(role, text)]}``."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    total = {}
    for prefix in sorted(members, key=len, reverse=True):
        children, leaves, below = total.get(prefix, (0, 0, 0))
        saved = below + (len(members[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0)
        total[prefix] = (children, leaves or 1, saved)
        if prefix:
            c, n, s = total.get(prefix[:-1], (0, 0, 0))
            total[prefix[:-1]] = (c + 1, n + total[prefix][1], s + saved)
    out = {}
    for prefix, convs in members.items():
        ends = sorted(c for c in convs if len(sequences[c]) == len(prefix))
        out[len(prefix), min(convs)] = (min(members[prefix[:-1]]) if prefix else None, len(convs), *total[prefix], ends)
    return out


def sequences_of(rows):
    out = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def got(nodes, ends):
    members = {}
    for e in ends.collect():
        members.setdefault((e["depth"], e["conv_id"]), []).append(e["member"])
    rows = nodes.collect()
    out = {(r["depth"], r["conv_id"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                                        sorted(members.get((r["depth"], r["conv_id"]), []))) for r in rows}
    assert len(out) == len(rows)
    return out


def made(rng):
    rows = []
    for conv in rng.sample(range(-50, 1000), 60):
        kind = rng.random()
        if kind < 0.3:  # a group of copies, some cut short
            turns = [("user", f"s{i}") for i in range(rng.choice([12, 12, 5]))]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["a", "bé", None, ""])) for _ in range(rng.randint(1, 6))]
        rows += [(conv, i if i else None, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 50_000), (2, 40), (3, 4)])
def test_against_dictionaries(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(trie_module, "LIMIT", limit)
    monkeypatch.setattr(trie_module, "BLOCK", 3)
    rows = made(random.Random(seed))
    turns = spark.createDataFrame([(*r, 5, "x") for r in [*rows, (None, 1, "user", "lost")]], TURNS + ", depth int, t1 string")
    assert got(*prefix_trie(*numbered_turns(turns))) == brute(sequences_of(rows))


def test_copies_and_one_conversation(spark, monkeypatch):
    """All alike, and a single one: no branches; turnless conversations end at the root."""
    monkeypatch.setattr(trie_module, "LIMIT", 5)
    rows = [(c, i, "user", "xy" * i) for c in range(9) for i in range(7)]
    assert got(*prefix_trie(*numbered_turns(spark.createDataFrame(rows, TURNS)))) == brute(sequences_of(rows))
    rows = [(4, i, "user", f"{i}") for i in range(20)]
    assert got(*prefix_trie(*numbered_turns(spark.createDataFrame(rows, TURNS)))) == brute(sequences_of(rows))
    turns, convs = numbered_turns(spark.createDataFrame(rows, TURNS))
    more = convs.unionByName(spark.createDataFrame([(2, 0), (9, 0)], convs.schema))
    assert got(*prefix_trie(turns, more)) == brute({**sequences_of(rows), 2: [], 9: []})
    nodes, ends = prefix_trie(*numbered_turns(spark.createDataFrame([], TURNS)))
    assert nodes.count() == 0 and ends.count() == 0


def test_digests_of_many_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie_module, "PIECE", 7)
    ends = spark.createDataFrame([(1, 0, m) for m in range(100)] + [(1, 5, 5), (2, 0, 3), (2, 0, -4)], "depth int, conv_id long, member long")
    found = {(r["depth"], r["conv_id"]): r["ends_sha256"] for r in end_digests(ends).collect()}
    want = {(1, 0): range(100), (1, 5): [5], (2, 0): [-4, 3]}
    assert found == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("limit", [50_000, 30])
def test_query_agrees_with_its_sql(spark, monkeypatch, limit):
    monkeypatch.setattr(trie_module, "LIMIT", limit)
    assert "op13_prefix_trie" in entry_module.oracle_sql()
    assert compare(spark, oracle_connection(SF_DIR), "op13_prefix_trie", SF_DIR) == []
