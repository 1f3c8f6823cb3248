"""Role repair against brute force over all paths, and conversations over many partitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from recordflow.llm.chat import (
    ASSISTANT, CLOSE, COSTS, ENDS, MOVES, NAMES, NEXT, START, SYSTEM, USER, _from, border_states, format_chats, product, repair,
)

SF_DIR = "/root/testdata/sf0.001"


def least_cost(roles):
    """Dijkstra-like relaxation over (turns read, state), insertions one by one."""
    best = {(0, START): 0}
    frontier = [(0, START)]
    while frontier:
        k, s = frontier.pop()
        cost, options = best[k, s], []
        options += [((k, n), COSTS["insert"]) for n in NEXT[s] if n != SYSTEM]
        if k < len(roles):
            options += [((k + 1, n), 0 if n == roles[k] else COSTS["relabel"]) for n in NEXT[s]]
            if s != START:
                options.append(((k + 1, s), COSTS["merge"] + (0 if s == roles[k] else COSTS["relabel"])))
        for key, extra in options:
            if cost + extra < best.get(key, 1 << 30):
                best[key] = cost + extra
                frontier.append(key)
    return best[len(roles), ASSISTANT]


def test_cost_is_least_for_all_short_conversations():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            total, steps = repair(list(roles))
            assert total == least_cost(roles)
            state, paid = START, 0
            for role, (to, action, path) in zip(roles, steps, strict=True):
                for inserted in path:
                    assert inserted in NEXT[state]
                    state, paid = inserted, paid + COSTS["insert"]
                assert (action == "merge" and to == state) or (action != "merge" and to in NEXT[state])
                paid += (COSTS["merge"] if action == "merge" else 0) + (0 if to == role else COSTS["relabel"])
                state = to
            assert paid <= total


def cut_repair(roles, cuts):
    """Steps of the pieces between cuts, each repaired alone, as partitions do."""
    bounds = [0, *cuts, len(roles)]
    pieces = [roles[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    ends = []
    for part, piece in enumerate(pieces):
        matrix = [_from(s) for s in range(4)]
        for r in piece:
            matrix = product(matrix, r)
        ends.append(("c", part, 0, len(piece), [x for row in matrix for x in (*row[0], *row[1])]))
    states, entry, steps = border_states(ends), START, []
    for part, piece in enumerate(pieces):
        leave, n = states.get((part, 0), (None, None))
        assert n is None or n == bounds[part + 1]
        steps += repair(piece, entry, leave)[1]
        entry = leave
    return steps


def test_cut_and_uncut_steps_are_equal_for_all_short_conversations():
    for n in range(2, 7):
        for roles in itertools.product(range(4), repeat=n):
            want = repair(list(roles))[1]
            for k in range(1, n):
                assert cut_repair(list(roles), [k]) == want, (roles, k)


@pytest.mark.parametrize("seed", range(20))
def test_conversations_of_many_pieces(seed):
    rng = random.Random(seed)
    roles = [rng.randrange(4) for _ in range(200)]
    for n in (1, 3, 9, 60):
        assert cut_repair(roles, sorted(rng.sample(range(1, 200), n))) == repair(roles)[1]


def test_the_first_sequence_of_states_wins():
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            total, steps = repair(list(roles))
            least = []
            for path in itertools.product(range(1, 4), repeat=n):
                pairs = list(zip((START, *path), path, strict=False))
                if all(p in MOVES[r] for p, r in zip(pairs, roles, strict=True)):
                    cost = sum(MOVES[r][p][0] for p, r in zip(pairs, roles, strict=True)) + ENDS[path[-1]][0]
                    least.append((cost, path))
            assert (total, tuple(s for s, _, _ in steps)) == min(least)


def render(rows):
    return "".join(r["rendered"] for r in sorted(rows, key=lambda r: r["place"]))


def turns_of(text):
    return [t.partition("|>\n") for t in text.removesuffix(CLOSE).split(CLOSE + "<|")]


def test_rendered_conversations_are_legal(spark):
    rows = [
        (1, 0, "User", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "first"), (2, 1, "user", "a"), (2, 2, "human", "b"),
        (3, 0, "system", "s"), (3, 1, None, "x <|user|> y"), (4, 0, "tool", None), (None, 0, "user", "n"), (5, None, "user", "z"), (5, 3, "gpt", "g"),
        (6, 0, "user", "same"), (6, 0, "user", "same"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    out = format_chats(docs)
    got = out.collect()
    assert out.columns == ["conv_id", "turn", "place", "role", "action", "rendered"] and len(got) == len(rows)
    text = {c: render([r for r in got if r["conv_id"] == c]) for c in {r["conv_id"] for r in got}}
    assert text[1] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert text[6] == "<|user|>\nsame<|end|>\n<|assistant|>\nsame<|end|>\n"
    assert "< |user|>" in text[3]
    for t in text.values():
        state = START
        for name, _, _ in turns_of(t.removeprefix("<|")):
            state = next(s for s in NEXT[state] if NAMES[s] == name)
        assert state == ASSISTANT
    assert format_chats(docs.limit(0)).count() == 0


def test_partitions_do_not_matter(spark):
    """One long conversation beside short ones, with ties of turns, over 1 and 50 partitions."""
    rng = random.Random(2)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system", "x"]), f"t{i}") for i in range(3000)]
    rows += [(k, i, rng.choice(["user", "assistant", "gpt", None]), "q" * (k % 3)) for k in [*range(6), *range(1000, 1100)] for i in range(k % 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            out = format_chats(turns)
            assert n == 1 or out.where("conv_id = 7").select(F.spark_partition_id().alias("p")).distinct().count() > 10
            found[n] = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[1] == found[50]
    for conv in (7, 1004):
        assert sorted(r[2] for r in found[1] if r[0] == conv) == list(range(3000 if conv == 7 else 4))
    text = "".join(r[5] for r in sorted((r for r in found[1] if r[0] == 7), key=lambda r: r[2]))
    state = START
    for name, _, _ in turns_of(text.removeprefix("<|")):
        state = next(s for s in NEXT[state] if NAMES[s] == name)
    assert state == ASSISTANT


def test_very_long_texts_stay_whole(spark):
    text = "wörd <|x|> " * 200_000
    got = format_chats(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).collect()
    assert text.replace("<|", "< |") in got[0]["rendered"]


def test_query(spark):
    import __spark_entry__ as entry_module

    got = entry_module.queries()["op8_chat"](spark, SF_DIR).collect()
    want = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    assert sorted((r["conv_id"], r["turn"]) for r in got) == sorted((r["conv_id"], r["turn"]) for r in want)
    assert USER in NAMES
