"""Chat formatting with the cheapest repair of roles.

Legal turns: at most one ``system`` turn at the start, then ``user`` and ``assistant`` in turn, an
assistant's last. Each turn of a conversation is kept, merged into the turn before, or given another
role, and empty turns are put in, so that the whole costs least (:data:`COSTS`). Of repairs that cost the same the one
wins whose sequence of states comes first, and for one step between two states the first of keep, merge,
relabel, insert. The costs of a turn are a matrix over
the states of this automaton, and those of many turns its min-plus product; beside each cost stands the place of its sequence
among those to the other states, which makes ties the same in a product as in its factors. So a conversation may span
any number of partitions, and its repair does not depend on them: each gives the matrix of the conversations at its ends, the driver fixes
the states at the borders (two rows for each partition), and each partition repairs its own turns.

Turns are range-sorted by conversation, turn, role and text hash; NULLs first, so ties of ``turn`` are settled by role, then by hash.
Result: one row for each turn, numbered by ``place`` from 0 in its conversation, whose ``rendered`` pieces in that order
are the formatted conversation. Roles are read in any case and by their usual synonyms; an unknown or NULL role is relabelled.
NULL texts count as empty; texts of any length are taken whole, a batch of them at a time; ``<|``
inside a text becomes ``< |``, so that no text can end its turn. Repeated turns are turns of their own; a
NULL ``conv_id`` is a conversation; an empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.storage import shared_dir

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COSTS = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
SYNONYMS = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT,
            "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
FOREVER = 1 << 60
ROWS = 1_000


def role_of(role: str | None) -> int:
    return SYNONYMS.get((role or "").strip().lower(), START)


def _inserted(state: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Empty turns that lead from ``state`` to others, at most two of them and never a system turn."""
    out = {state: (0, ())}
    frontier = [(state, ())]
    for _ in range(2):
        frontier = [(n, (*path, n)) for s, path in frontier for n in NEXT[s] if n != SYSTEM]
        for n, path in frontier:
            out.setdefault(n, (COSTS["insert"] * len(path), path))
    return out


def _moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """``(state, next state) -> (cost, action, inserted)`` of a turn with this role; START for an unknown one."""
    best: dict[tuple[int, int], tuple[int, int, str, tuple[int, ...]]] = {}

    def offer(state: int, to: int, cost: int, action: str, path: tuple[int, ...] = ()) -> None:
        rank = list(COSTS).index("insert" if path else action)
        if (state, to) not in best or (cost, rank) < best[state, to][:2]:
            best[state, to] = (cost, rank, action, path)

    for state in range(4):
        for reached, (cost, path) in _inserted(state).items():
            for to in NEXT[reached]:
                same = to == role
                offer(state, to, cost + (0 if same else COSTS["relabel"]), "keep" if same else "relabel", path)
        if state != START:
            offer(state, state, COSTS["merge"] + (0 if state == role else COSTS["relabel"]), "merge")
    return {k: (c, a, p) for k, (c, _, a, p) in best.items()}


MOVES = {role: _moves(role) for role in range(4)}
ENDS = {state: _inserted(state)[ASSISTANT] for state in range(4)}


# For each state: least cost, and the place of the first sequence of that cost among those to the other states.
Front = tuple[list[int], list[int]]


def _from(state: int) -> Front:
    return [0 if s == state else FOREVER for s in range(4)], list(range(4))


def _join(front: Front, cost: dict[tuple[int, int], int], order: dict[tuple[int, int], int]) -> tuple[Front, list[int]]:
    """Front behind one more piece with costs and orders of ``(state before, state behind)``, and the states before."""
    costs, ranks = front
    new, back = [FOREVER] * 4, [-1] * 4
    for (state, to), more in sorted(cost.items()):
        if costs[state] < FOREVER and more < FOREVER:
            least = (costs[state] + more, ranks[state])
            if back[to] < 0 or least < (new[to], ranks[back[to]]):
                new[to], back[to] = least[0], state
    placed = sorted(range(4), key=lambda to: (new[to] >= FOREVER, ranks[back[to]] if back[to] >= 0 else 0, order.get((back[to], to), to)))
    return (new, [placed.index(to) for to in range(4)]), back


_STEP_COSTS = {role: {k: c for k, (c, _, _) in moves.items()} for role, moves in MOVES.items()}
_STEP_ORDER = {(state, to): to for state in range(4) for to in range(4)}


def _step(front: Front, role: int) -> tuple[Front, list[int]]:
    return _join(front, _STEP_COSTS[role], _STEP_ORDER)


def _last(front: Front) -> tuple[int, int]:
    """Least whole cost and the state behind the last turn."""
    total, _, state = min((front[0][s] + ENDS[s][0], front[1][s], s) for s in range(4))
    return total, state


def product(matrix: list[Front], role: int) -> list[Front]:
    """Fronts from each state at the start, behind one more turn."""
    return [_step(row, role)[0] for row in matrix]


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[int, list[tuple[int, str, tuple[int, ...]]]]:
    """Least cost, and ``(state, action, inserted before)`` of each turn.

    ``entry`` is the state before the first turn, ``leave`` that behind the last, or NULL where the conversation ends.
    """
    front, backs = _from(entry), []
    for role in roles:
        front, back = _step(front, role)
        backs.append(back)
    total, state = _last(front) if leave is None else (front[0][leave], leave)
    out = []
    for role, back in zip(reversed(roles), reversed(backs), strict=True):
        before = back[state]
        _, action, path = MOVES[role][before, state]
        out.append((state, action, path))
        state = before
    return total, out[::-1]


def _open(state: int) -> str:
    return f"<|{NAMES[state]}|>\n"


CLOSE = "<|end|>\n"


def _pieces(texts: list[str], steps: list, entry: int, ends: bool) -> Iterator[str]:
    state = entry
    for k, (text, (to, action, path)) in enumerate(zip(texts, steps, strict=True)):
        parts = []
        if action == "merge":
            parts.append("\n")
        else:
            if state != START:
                parts.append(CLOSE)
            parts += [_open(s) + CLOSE for s in path]
            parts.append(_open(to))
        parts.append(text)
        state = to
        if ends and k + 1 == len(texts):
            parts.append(CLOSE)
            parts += [_open(s) + CLOSE for s in ENDS[to][1]]
        yield "".join(parts)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, tuple]]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield from ((row[0], row[1:]) for row in zip(*columns, strict=True))


def _summary(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Turns and matrix of the first and of the last conversation of a partition; one row if they are the same."""
    key, matrix, n, found = None, None, 0, []
    for conv, (role,) in _runs(batches):
        if matrix is None or conv != key:
            if matrix is not None and not found:
                found.append((key, n, matrix))
            key, matrix, n = conv, [_from(s) for s in range(4)], 0
        matrix, n = product(matrix, role_of(role)), n + 1
    if matrix is not None:
        found.append((key, n, matrix))
    part = TaskContext.get().partitionId()
    whole = [[x for row in m for x in (*row[0], *row[1])] for _, _, m in found]
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], id_type), pa.array([part] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()),
         pa.array([f[1] for f in found], pa.int64()), pa.array(whole, pa.list_(pa.int64()))], names=["conv_id", "part", "last", "turns", "matrix"])


def border_states(ends: list[tuple[object, int, int, int, list[int]]]) -> dict[tuple[int, int], tuple[int, int]]:
    """State at the border behind ``(part, last)`` and the turns up to there, of conversations that go on in the next part.

    ``ends`` holds ``(conversation, part, 0 for a part's first or 1 for its last, turns, matrix)`` in order.
    """
    chains, states = [], {}
    for end in ends:
        if chains and chains[-1][-1][0] == end[0] and chains[-1][-1][1] != end[1]:
            chains[-1].append(end)
        else:
            chains.append([end])
    for chain in chains:
        front, backs = _from(START), []
        for *_, m in chain:
            cost = {(s, to): m[8 * s + to] for s in range(4) for to in range(4)}
            order = {(s, to): m[8 * s + 4 + to] for s in range(4) for to in range(4)}
            front, back = _join(front, cost, order)
            backs.append(back)
        state = _last(front)[1]
        for k in range(len(chain) - 1, 0, -1):
            state = backs[k][state]
            states[chain[k - 1][1:3]] = (state, sum(end[3] for end in chain[:k]))
    return states


RESULT = "turn {turn}, place long, role string, action string, rendered string"


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, place, role, action, rendered)`` of every turn."""
    shared_dir(turns.sparkSession)  # for checkpoint()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    table = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"),
        F.replace(body, F.lit("<|"), F.lit("< |")).alias("text"))
    keys = ["conv_id", "turn", "role", F.xxhash64("text")]
    # Written as it is dealt out: partitions and their order stay the same for both passes.
    table = table.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()
    id_field, turn_field = table.schema["conv_id"], table.schema["turn"]
    id_name, turn_name = id_field.dataType.simpleString(), turn_field.dataType.simpleString()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _summary(_with(first, batches), first.column(0).type)

    ends = table.select("conv_id", "role").mapInArrow(summary, f"conv_id {id_name}, part int, last int, turns long, matrix array<long>")
    ends = sorted((tuple(r) for r in ends.collect()), key=lambda r: (r[1], r[2]))
    states = border_states(ends)
    ends_of = {}
    for _, part, last, *_ in ends:
        ends_of.setdefault(part, []).append(last)
    parts = sorted(ends_of)
    leave = {part: states.get((part, ends_of[part][-1])) for part in parts}
    enter = {part: leave[before] for before, part in zip(parts, parts[1:], strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        types = (first.column(0).type, first.column(1).type)
        entry, place = enter.get(part) or (None, 0)
        key, rows, out = None, [], []

        def solved(leaving: int | None) -> Iterator[tuple]:
            nonlocal place
            begin = START if entry is None else entry
            _, steps = repair([role_of(r[1]) for r in rows], begin, leaving)
            for (turn_no, _, _), step, piece in zip(rows, steps, _pieces([r[2] for r in rows], steps, begin, leaving is None), strict=True):
                yield (key, turn_no, place, NAMES[step[0]], "insert" if step[2] else step[1], piece)
                place += 1

        for conv, row in _runs(_with(first, batches)):
            if rows and conv != key:
                out += solved(None)
                rows, entry, place = [], None, 0
                if len(out) >= ROWS:
                    yield _batch(out, types)
                    out = []
            key = conv
            rows.append(row)
        going_on = leave.get(part)
        out += solved(None if going_on is None else going_on[0])
        yield _batch(out, types)

    return table.mapInArrow(run, f"conv_id {id_name}, " + RESULT.format(turn=turn_name))


def _with(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _batch(rows: list[tuple], types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    kinds = [*types, pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "turn", "place", "role", "action", "rendered"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
