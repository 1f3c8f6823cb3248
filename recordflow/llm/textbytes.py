"""Words, lines and their hashes as numpy arrays over the UTF-8 bytes of an Arrow column.

A batch is taken in chunks of whole texts of at most ``CHUNK_BYTES`` (a longer text is a chunk
of its own), so a task's memory is a small multiple of that, whatever the table's size.
Every hash is 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 256 * 1024
# For work that gains from seeing many texts at once.
WIDE_CHUNK_BYTES = 2 * 1024 * 1024

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
BASE = _U(0x2545F4914F6CDD1D)
BASE_INVERSE = _U(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words [^\x20\x09-\x0D]+.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False


@dataclass
class Chunk:
    """Whole texts: bytes of all of them and, for text ``i``, ``offsets[i]:offsets[i + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Spans:
    """Byte ranges in a chunk, in order, with the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of one batch (NULL as empty), in chunks."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        stop = min(max(stop, at + 1), n)
        yield Chunk(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def spans(chunk: Chunk, inside: np.ndarray) -> Spans:
    """Longest runs of bytes for which the table ``inside`` is true; runs end with their text."""
    mask = inside[chunk.data]
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[chunk.offsets] = True
    joined = mask[1:] & mask[:-1] & ~edge[1:-1]
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~joined
    ends[:-1] &= ~joined
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Spans(start, end, text_of(chunk, start))


def words(chunk: Chunk) -> Spans:
    return spans(chunk, NOT_BLANK)


def lines(chunk: Chunk) -> Spans:
    """Lines split at ``\\n``, empty ones included; every text has at least one."""
    breaks = np.flatnonzero(chunk.data == 10)
    start = np.concatenate([breaks + 1, chunk.offsets[:-1]])
    end = np.concatenate([breaks, chunk.offsets[1:]])
    text = np.concatenate([text_of(chunk, breaks), np.arange(chunk.size)])
    # A text's own start comes before those after its breaks; its end behind those of its breaks.
    by_start, by_end = np.lexsort((start, text)), np.lexsort((end, text))
    return Spans(start[by_start], end[by_end], text[by_start])


def text_of(chunk: Chunk, position: np.ndarray) -> np.ndarray:
    return np.searchsorted(chunk.offsets, position, side="right") - 1


class SpanHasher:
    """Hash of any span of a chunk in constant time, from one pass over its bytes."""

    def __init__(self, data: np.ndarray):
        powers = _powers(BASE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(BYTE_HASH[data] * powers[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _powers(BASE_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(_U))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; the table for whole chunks is kept, longer ones are made anew."""
    table = _POWERS.get(int(base))
    if table is None or len(table) < n:
        size = max(n, CHUNK_BYTES + 1)
        table = np.full(size, base, dtype=_U)
        table[0] = 1
        table = np.cumprod(table, dtype=_U)
        if size == CHUNK_BYTES + 1:
            _POWERS[int(base)] = table
    return table[:n]


def word_hashes(chunk: Chunk, found: Spans, lower: bool = False) -> np.ndarray:
    return SpanHasher(LOWER[chunk.data] if lower else chunk.data)(found.start, found.end)


def windows(hashes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, place of its first word)`` of each window of ``width`` words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    value = hashes[at]
    for k in range(1, width):
        value = mix(value * _U(0x9E3779B97F4A7C15) + hashes[at + k])
    return value, at


def counts(text: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Number (or exact integer sum of ``weights``) of each text ``0..n-1``."""
    if weights is None:
        return np.bincount(text, minlength=n).astype(np.int64)
    sums = np.zeros(len(text) + 1, dtype=np.int64)
    np.cumsum(weights, out=sums[1:])
    edges = np.searchsorted(text, np.arange(n + 1))
    return sums[edges[1:]] - sums[edges[:-1]]
