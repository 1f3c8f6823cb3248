"""Benchmark decontamination: documents that hold a passage within a small edit distance of an item.

Symbols are words (runs of digits, letters and other non-ASCII characters, A-Z lowered); words of no
item are one symbol. A CGK walk reads a window and stays or steps on by a random bit of (step,
symbol), so that two windows few edits apart mostly show the same symbol at the same step. Each
repetition of the search takes a few random steps of the walk as its key (bit sampling) and meets
the items with an equal key at those steps. Windows begin at every word and are as long as the items
of a length class; those with too few words of the class within an item's length cannot match and
are left out first. An item of more than SEGMENT words is searched by its segments, each at its own
place: if each were further from its part of a passage than ``max_rate`` allows for its length, so
would the item be from the whole; so one at least is near. What meets is verified on the whole item
by exact edit distance over words, so nothing that is reported is a chance hit. A match has at most
``max_rate`` edits for each word of the item, rounded down.

The benchmark is cut in blocks of bounded size; each is one pass over the documents, which are never
shuffled. Within a pass every text is searched from end to end.

NULL texts and ids, empty texts and items without words match nothing; repeated rows are searched
one by one, repeated items reported once for each id. A benchmark without rows matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm import textbytes as tb
from recordflow.llm.tables import map_column
from recordflow.storage import cut

MAX_RATE = 0.2
SAMPLED = 3
# Recall of windows at the largest distance: 0.99 (0.2 edits a word), 1.00 at half of it.
REPETITIONS = 32
# A walk covers all words of what it searches for; items of more words are cut in equal segments.
SEGMENT = 60
CLASS_RATIO = 1.15
# Items of a length class that share a filter; larger benchmarks make at most about CLASSES classes.
CLASS_ITEMS = 16
CLASSES = 64
BLOCK_BYTES = 4 * 1024 * 1024
# Blocks searched in one stage, each with a worker and a broadcast of its own.
BLOCKS_AT_ONCE = 4
MATCHES = "array<struct<item_id: long, distance: int, start: int, end: int>>"

_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class _Repetition:
    steps: list[int]
    first: np.ndarray  # symbols that any item of the class shows at the first step
    keys: np.ndarray
    segments: list[list[int]]


@dataclass
class _Class:
    shortest: int
    longest: int
    known: np.ndarray  # symbols of the class's segments
    repetitions: list[_Repetition]


class ItemIndex:
    """Items of one block with their keys in every repetition."""

    def __init__(self, items: list[tuple[int, str]], max_rate: float = MAX_RATE, sampled: int = SAMPLED,
                 repetitions: int = REPETITIONS, seed: int = 1):
        self.seed, self.max_rate = seed, max_rate
        self.ids = [i for i, _ in items]
        hashed = _hashed_words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        self.pad = len(self.vocabulary) + 1
        self.words = [self.symbols(h) for h in hashed]
        self.masks = [_masks(w) for w in self.words]
        # Segments as (item, first word, word after); most items are one.
        self.segments = [(i, start, stop) for i, w in enumerate(self.words) for start, stop in _segments(len(w))]
        self.classes: list[_Class] = []
        self._bits: dict[tuple[int, int], np.ndarray] = {}
        rng = np.random.default_rng(seed)
        length = [stop - start for _, start, stop in self.segments]
        order = sorted(range(len(length)), key=lambda s: length[s])
        while order:
            shortest = length[order[0]]
            members = [s for s in order if length[s] <= shortest * CLASS_RATIO]
            members = members[: max(CLASS_ITEMS, len(length) // CLASSES)]
            order = order[len(members) :]
            known = np.zeros(self.pad + 1, dtype=bool)
            known[np.concatenate([self._symbols_of(s) for s in members])] = True
            n_steps = max(1, int(1.6 * shortest))
            made = [self._repetition(r, sorted(rng.integers(0, n_steps, sampled).tolist()), members) for r in range(repetitions)]
            self.classes.append(_Class(shortest, length[members[-1]], known, made))

    def _symbols_of(self, segment: int) -> np.ndarray:
        item, start, stop = self.segments[segment]
        return self.words[item][start:stop]

    def edits(self, n: int) -> int:
        return int(self.max_rate * n + 1e-9)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word: its place in the vocabulary from 1 on, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def bits(self, repetition: int, block: int) -> np.ndarray:
        """64 steps of the walk's random bits for each symbol; nothing moves on from the end."""
        if (repetition, block) in self._bits:
            return self._bits[repetition, block]
        salt = np.uint64((self.seed * 1_000_003 + repetition) * 64 + block)
        values = tb.mix(np.concatenate([np.zeros(1, np.uint64), self.vocabulary, np.zeros(1, np.uint64)]) + tb.mix(np.array([salt])))
        values[-1] = 0
        self._bits[repetition, block] = values
        return values

    def walk(self, symbols: np.ndarray, at: np.ndarray, repetition: int, begin: int, stop: int) -> np.ndarray:
        """Places after steps ``begin..stop - 1`` from ``at``; ``symbols`` ends with the end symbol."""
        for step in range(begin, stop):
            if step == begin or step % 64 == 0:
                bits = self.bits(repetition, step // 64)
            at = at + ((bits[symbols[at]] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
        return at

    def _repetition(self, r: int, steps: list[int], members: list[int]) -> _Repetition:
        by_key: dict[int, list[int]] = {}
        parts = [np.append(self._symbols_of(s), self.pad) for s in members]
        symbols = np.concatenate(parts)
        at, begin = np.cumsum([0, *map(len, parts[:-1])]), 0
        first = np.zeros(self.pad + 1, dtype=bool)
        key = np.zeros(len(members), dtype=np.uint64)
        for k, step in enumerate(steps):
            at, begin = self.walk(symbols, at, r, begin, step), step
            if k == 0:
                first[symbols[at]] = True
            key = key * np.uint64(self.pad + 1) + symbols[at].astype(np.uint64)
        for s, k in zip(members, key.tolist(), strict=True):
            by_key.setdefault(k, []).append(s)
        keys = np.array(sorted(by_key), dtype=np.uint64)
        return _Repetition(steps, first, keys, [by_key[int(k)] for k in keys])

    def candidates(self, symbols: np.ndarray) -> set[tuple[int, int]]:
        """``(place, segment)`` of windows that meet a segment; texts in ``symbols`` end with the end symbol."""
        met: set[tuple[int, int]] = set()
        known = np.zeros(len(symbols) + 1, dtype=np.int32)
        places = np.arange(len(symbols))
        for c in self.classes:
            np.cumsum(c.known[symbols], out=known[1:])
            stop = np.minimum(places + c.longest + self.edits(c.longest), len(symbols))
            enough = known[stop] - known[:-1] >= min(n - self.edits(n) for n in range(c.shortest, c.longest + 1))
            starts = np.flatnonzero(enough & (symbols != self.pad))
            if not len(starts):
                continue
            for r, rep in enumerate(c.repetitions):
                begin, at, start = 0, starts, starts
                key = np.zeros(len(starts), dtype=np.uint64)
                for k, step in enumerate(rep.steps):
                    at, begin = self.walk(symbols, at, r, begin, step), step
                    shown = symbols[at]
                    if k == 0:
                        keep = rep.first[shown]
                        at, start, key, shown = at[keep], start[keep], key[keep], shown[keep]
                    key = key * np.uint64(self.pad + 1) + shown.astype(np.uint64)
                found = np.minimum(np.searchsorted(rep.keys, key), len(rep.keys) - 1)
                hit = np.flatnonzero(rep.keys[found] == key)
                for place, f in zip(start[hit].tolist(), found[hit].tolist(), strict=True):
                    met.update((place, segment) for segment in rep.segments[f])
        return met

    def matches(self, symbols: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """Verified matches of each text, best place of each item; ``ends`` are the places of end symbols."""
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        by_text: dict[tuple[int, int], list[tuple[int, int]]] = {}
        met = self.candidates(symbols)
        places = np.array([p for p, _ in met], dtype=np.int64)
        texts = np.searchsorted(ends, places, side="left").tolist()
        for (place, segment), text in zip(met, texts, strict=True):
            item, start, stop = self.segments[segment]
            # Edits move the item's place; a window may also begin some words off its segment.
            spare = self.edits(len(self.words[item])) + (self.edits(stop - start) if stop - start < len(self.words[item]) else 0)
            by_text.setdefault((text, item), []).append((place - start - spare, place - start + len(self.words[item]) + spare))
        for (text, item), found in by_text.items():
            n = len(self.words[item])
            k = self.edits(n)
            low, high = (int(ends[text - 1]) + 1 if text else 0), int(ends[text])
            best, begin, stop = None, None, -1
            found.sort()
            for area in [*found, None]:
                if begin is not None and (area is None or area[0] > stop):
                    got = edit_match(self.masks[item], n, symbols[begin:stop].tolist())
                    if got[0] <= k and (best is None or (got[0], begin + got[1]) < best):
                        best = (got[0], begin + got[1])
                    begin = None
                if area is None:
                    break
                begin = max(low, area[0]) if begin is None else begin
                stop = max(stop, min(high, area[1]))
            if best is not None:
                start = _start(self.words[item], symbols[max(low, best[1] - n - best[0]) : best[1]], best[0])
                out.setdefault(text, []).append((self.ids[item], best[0], best[1] - start - low, best[1] - low))
        return out


def _segments(n: int) -> list[tuple[int, int]]:
    """Equal cuts of ``n`` words, none longer than SEGMENT."""
    count = -(-n // SEGMENT)
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


def _hashed_words(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for chunk in tb.chunks(texts):
        found = tb.spans(chunk, _WORD)
        hashes = tb.word_hashes(chunk, found, lower=True)
        edges = np.searchsorted(found.text, np.arange(chunk.size + 1))
        out += [hashes[edges[i] : edges[i + 1]] for i in range(chunk.size)]
    return out


def _masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    return masks


def edit_match(masks: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of ``text``, and the end of the first such run.

    Bit-parallel dynamic programming: one column of the distance table as two bit vectors.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, symbol in enumerate(text, 1):
        equal = masks.get(symbol, 0)
        vertical = equal | minus
        equal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(equal | plus) & full)
        down = plus & equal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


def _start(words: np.ndarray, before: np.ndarray, distance: int) -> int:
    """Length of the shortest run at the end of ``before`` at this distance from the item.

    The words backwards, bit-parallel like :func:`edit_match`; here every word of a run counts, from its first on.
    """
    n, masks, text = len(words), _masks(words[::-1]), before[::-1].tolist()
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    for j, symbol in enumerate(text, 1):
        equal = masks.get(symbol, 0)
        vertical = equal | minus
        equal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(equal | plus) & full)
        down = plus & equal
        score += bool(up & top) - bool(down & top)
        if score == distance:
            return j
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
    return len(text)


def search(index: ItemIndex, texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    """Matches ``(item, edits, first word, word after)`` of each text, by item."""
    out: list[list] = [[] for _ in range(len(texts))]
    for chunk in tb.chunks(texts, tb.WIDE_CHUNK_BYTES):
        found = tb.spans(chunk, _WORD)
        words = index.symbols(tb.word_hashes(chunk, found, lower=True))
        ends = np.cumsum(tb.counts(found.text, chunk.size)) + np.arange(chunk.size)
        symbols = np.full(len(words) + chunk.size, index.pad, dtype=np.int64)
        symbols[np.arange(len(words)) + found.text] = words
        for text, matches in index.matches(symbols, ends).items():
            out[chunk.first + text] = sorted(matches)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "matches", max_rate: float = MAX_RATE,
               keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with an array of matches ``(item_id, distance, start, end)``, words from 0."""
    keep = [c for c in (keep or docs.columns) if c != name]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    column = "text" if "text" in keep else "__text"
    table = docs.withColumn(column, F.col("text")).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, column])], F.array().cast(MATCHES).alias(name))
    for block in range(blocks):
        # A block's expected size is BLOCK_BYTES: nothing larger reaches the driver at a time.
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().collect()
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(sorted(map(tuple, rows)), max_rate))
        more = [column] if column not in keep and block + 1 < blocks else []
        table = _search_block(table, index, column, [*keep, *more], name)
        if (block + 1) % BLOCKS_AT_ONCE == 0 and block + 1 < blocks:
            # What a stage holds at once stays bounded, whatever the size of the benchmark.
            table = cut(table, "searched")
    return table


def _search_block(table: DataFrame, index, column: str, keep: list[str], name: str) -> DataFrame:
    def match(texts: pa.Array) -> list[pa.Array]:
        named = [[{"item_id": i, "distance": d, "start": s, "end": e} for i, d, s, e in found] for found in search(index.value, texts)]
        return [pa.array(named, _MATCH)]

    searched = map_column(table, column, [*keep, name], {"__new": MATCHES}, match)
    return searched.withColumn(name, F.array_sort(F.concat(name, "__new"))).drop("__new")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Documents without a match, unchanged."""
    found = find_leaks(docs, benchmark, "__matches", max_rate)
    return found.where(F.size("__matches") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
