"""Periodic runs of words: maximal stretches that repeat one period over and over.

A run is a stretch of words with smallest period q, at least ``min_exponent * q`` words long (``min_length`` at
least), that no neighbouring word extends. They are found by internal pattern matching, over all texts of a chunk at
once in numpy arrays:

* every window of 2^k words gets its rank among all such windows (prefix doubling). The last ranks are the suffix
  array, and equal windows stand together in it;
* a dyadic block of 2^k words asks for its own occurrences in the window behind it, 2^k to 2^(k+1) words on: a range
  successor query on a wavelet matrix over the suffix array. A second successor gives the step of the
  arithmetic progression that these occurrences form; its members are the candidate periods. A run of at
  least three periods holds such a block, whatever its place;
* common extension to both sides, by the same ranks, gives the stretch of a candidate; of several periods of
  one stretch the smallest stays.

Every pair of neighbouring words inside a run occurs ``min_exponent - 1`` times in its text. Stretches of such pairs are
searched, the rest is passed over, which loses nothing and leaves little of ordinary prose.

Time is n log^2 n in the words searched, memory about 16 log n bytes for each. Texts are taken whole and never
meet in one another's windows; a very long one is a chunk of its own. NULL and empty texts have no words and no
runs; repeated rows are searched one by one; an empty table gives an empty result. Of runs with one start the shorter
period comes first. Kept columns with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordflow.llm import textbytes as tb
from recordflow.llm.tables import map_column

RESULTS = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}

_U = np.uint64


class Wavelet:
    """Wavelet matrix: counts, k-th values and successors in ranges of a sequence, for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place, from the highest bit on
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of the range are less than ``value``."""
        count = np.where(value >> self.bits > 0, high - low, 0)
        for k, zeros in enumerate(self.zeros):
            one = (value >> (self.bits - 1 - k)) & 1 == 1
            z_low, z_high = zeros[low], zeros[high]
            count = count + np.where(one & (value >> self.bits == 0), z_high - z_low, 0)
            low, high = np.where(one, zeros[-1] + low - z_low, z_low), np.where(one, zeros[-1] + high - z_high, z_high)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` less ones in the range."""
        value = np.zeros(len(low), dtype=np.int64)
        for zeros in self.zeros:
            z_low, z_high = zeros[low], zeros[high]
            one = k >= z_high - z_low
            value = 2 * value + one
            k = np.where(one, k - (z_high - z_low), k)
            low, high = np.where(one, zeros[-1] + low - z_low, z_low), np.where(one, zeros[-1] + high - z_high, z_high)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The least value of the range that is at least ``value``, or the sequence's length if there is none."""
        less = self.below(low, high, value)
        found = less < high - low
        out = np.full(len(low), len(self.zeros[0]) - 1, dtype=np.int64)
        out[found] = self.kth(low[found], high[found], less[found])
        return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


class Stretches:
    """Words of several stretches, one behind the other, with the ranks of their dyadic windows.

    ``words`` are hashes and ``stretch`` their stretch, ascending. Windows of two stretches never have the same rank.
    """

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        n = len(words)
        order = np.lexsort((words, stretch))
        new = np.ones(n, dtype=np.int64)
        new[1:] = (words[order][1:] != words[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])
        first = np.empty(n, dtype=np.int32)
        first[order] = np.cumsum(new) - 1
        edges = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
        sizes = np.diff(np.append(edges, n))
        self.begin, self.end = np.repeat(edges, sizes), np.repeat(edges + sizes, sizes)
        self.longest = int(sizes.max())
        self.ranks, at, width = [first], np.arange(n), 1
        while self.ranks[-1].max() + 1 < n:
            rank = self.ranks[-1].astype(np.int64)
            behind = np.zeros(n, dtype=np.int64)
            inside = at + width < self.end
            behind[inside] = rank[at[inside] + width] + 1
            self.ranks.append(_dense(rank * (n + 1) + behind))
            width *= 2
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[self.ranks[-1]] = at
        self.suffixes = Wavelet(suffixes)
        # A place behind the last word, unlike all others.
        self.padded = [np.append(r, np.int32(-1)) for r in self.ranks]

    def extend(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words agree before ``x`` and ``y``, and from there on."""
        ahead, back = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.padded[k], 1 << k
            ahead += np.where(rank[x + ahead] == rank[y + ahead], width, 0)
            at = x - back - width
            inside = at >= self.begin[x]
            at = np.where(inside, at, 0)
            back += np.where(inside & (rank[at] == rank[np.where(inside, y - back - width, 0)]), width, 0)
        return back, ahead

    def runs(self, min_length: int, min_exponent: int) -> np.ndarray:
        """Rows ``(start, end, period)`` of all runs, in order."""
        n, found = len(self.begin), [np.zeros((0, 3), dtype=np.int64)]
        for k, rank in enumerate(self.ranks[:-1]):
            width = 1 << k
            if min_exponent * width > self.longest:
                break
            starts = np.zeros(int(rank.max()) + 2, dtype=np.int64)
            np.cumsum(np.bincount(rank), out=starts[1:])
            x = np.arange(0, n, width)
            x = x[(x + width <= self.end[x]) & (starts[rank[x] + 1] - starts[rank[x]] > 1)]
            low, high, limit = starts[rank[x]], starts[rank[x] + 1], np.minimum(x + 2 * width, n)
            y = self.suffixes.successor(low, high, x + width)
            hit = y < limit
            x, y, low, high, limit = x[hit], y[hit], low[hit], high[hit], limit[hit]
            second = self.suffixes.successor(low, high, y + 1)
            step = np.where(second < limit, second - y, width)
            members = (limit - 1 - y) // step + 1
            x, y, step = np.repeat(x, members), np.repeat(y, members), np.repeat(step, members)
            y = y + step * (np.arange(len(y)) - np.repeat(np.cumsum(members) - members, members))
            hit = rank[x] == rank[y]
            x, y = x[hit], y[hit]
            back, ahead = self.extend(x, y)
            long = back + ahead + (y - x) >= np.maximum(min_length, min_exponent * (y - x))
            x, y, back, ahead = x[long], y[long], back[long], ahead[long]
            found.append(np.unique(np.stack([x - back, y + ahead, y - x], axis=1), axis=0))
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[first]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _frequent_stretches(hashes: np.ndarray, text: np.ndarray, least: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, stretch)`` of the words in stretches whose neighbouring pairs all occur ``least`` times in their text."""
    n = len(hashes)
    good = np.zeros(n + 1, dtype=bool)  # good[i + 1]: the pair of words i and i + 1
    if n > 1:
        pair = tb.mix(hashes[:-1] * _U(0x9E3779B97F4A7C15) + hashes[1:]) ^ tb.mix(text[:-1].astype(_U))
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        good[1:-1] = (count[inverse] >= least) & (text[1:] == text[:-1])
    inside = good[:-1] | good[1:]
    place = np.flatnonzero(inside)
    number = np.cumsum(~good[:-1])[place]
    if len(place):
        edges = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        sizes = np.diff(np.append(edges, len(place)))
        long = np.repeat(sizes >= min_length, sizes)
        place, number = place[long], number[long]
    return place, number


def word_runs(hashes: np.ndarray, text: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows ``(first word, length, period)`` of the runs of words given by hash and (ascending) text."""
    place, stretch = _frequent_stretches(hashes, text, min_exponent - 1, max(min_length, min_exponent))
    if not len(place):
        return np.zeros((0, 3), dtype=np.int64)
    rows = Stretches(hashes[place], stretch).runs(min_length, min_exponent)
    return np.stack([place[rows[:, 0]], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)


def _joined(chunk: tb.Chunk, found: tb.Spans, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, with one space between."""
    start, size, text = found.start[kept], (found.end - found.start)[kept], found.text[kept]
    more = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    lengths = size + more
    at = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    source = np.repeat(start - at, lengths) + np.arange(total)
    out = chunk.data[np.minimum(source, max(len(chunk.data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[(at + size)[more]] = 32
    offsets = np.zeros(chunk.size + 1, dtype=np.int32)
    np.cumsum(tb.counts(text, chunk.size, lengths), out=offsets[1:])
    return pa.StringArray.from_buffers(chunk.size, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))


def _chunk_results(chunk: tb.Chunk, min_length: int, min_exponent: int) -> list[pa.Array]:
    found = tb.words(chunk)
    rows = word_runs(tb.word_hashes(chunk, found), found.text, min_length, min_exponent)
    text = found.text[rows[:, 0]]
    cover = np.zeros(len(found) + 1, dtype=np.int64)
    np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
    np.add.at(cover, rows[:, 0] + rows[:, 1], -1)
    n_words = tb.counts(found.text, chunk.size)
    first = np.cumsum(n_words) - n_words
    offsets = np.searchsorted(text, np.arange(chunk.size + 1)).astype(np.int32)
    parts = [pa.array(v) for v in (rows[:, 0] - first[text], rows[:, 1], rows[:, 2])]
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
    return [pa.array(n_words), runs, _joined(chunk, found, np.cumsum(cover)[:-1] == 0)]


def find_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``keep`` columns (all but the text), ``n_words``, the ``runs`` in order, and the text ``collapsed``.

    Run starts are word numbers from 0. In the collapsed text every run keeps its first period only; words are
    joined by one space. ``min_exponent`` must be at least 3.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be at least 3")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS and (keep is not None or c != text)]

    def run(texts: pa.Array) -> list[pa.Array]:
        parts = [_chunk_results(c, min_length, min_exponent) for c in tb.chunks(texts)]
        return [pa.concat_arrays(columns) for columns in zip(*parts, strict=True)]

    return map_column(docs, text, kept, RESULTS, run)
