"""Token counts of documents by a unigram model over a given vocabulary of pieces.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+``, each with the word mark in front. A word's tokens
are its best segmentation: the highest sum of piece scores, then the fewest tokens; a character
that no piece covers costs ``UNKNOWN_SCORE`` and one token per UTF-8 byte.

The distinct words of a chunk are put in a trie. A node stands for a prefix and holds the best
score and count of that prefix, computed once and shared by all words that begin with it; the
counts at terminal nodes are stored for the words. Sorted order makes the walk depth first, so
only the nodes of one path are held at a time.

NULL and empty texts have no tokens; repeated rows are counted one by one; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordflow.llm import textbytes as tb
from recordflow.llm.tables import map_column

WORD_MARK = "▁"
UNKNOWN_SCORE = -20.0
CACHE_WORDS = 200_000


def load_pieces(model_file: str) -> dict[str, float]:
    """Pieces of a sentencepiece file, scored as ``-log(rank + 2)``, rank 0 first.

    Control, unknown and byte pieces are left out: bytes are counted for unknown characters.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranked = sorted(ids, key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(ranked)}


class TrieCounter:
    """Best segmentation of many words at once."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)

    def count(self, words: Iterable[str]) -> dict[str, int]:
        pieces, longest = self.pieces, self.longest
        out: dict[str, int] = {}
        # The path from the root: prefix i of the current word has score best[i] and size[i] tokens.
        path, best, size = "", [0.0], [0]
        for word in sorted(set(words)):
            marked = WORD_MARK + word
            shared = _common_prefix(path, marked)
            del best[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                top, few = best[end - 1] + UNKNOWN_SCORE, size[end - 1] + len(marked[end - 1].encode("utf-8", "replace"))
                for begin in range(max(0, end - longest), end):
                    score = pieces.get(marked[begin:end])
                    if score is not None:
                        total, n = best[begin] + score, size[begin] + 1
                        if total > top or (total == top and n < few):
                            top, few = total, n
                best.append(top)
                size.append(few)
            path = marked
            out[word] = size[-1]
        return out


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


class _Counter:
    """Counts by word hash, kept between the batches of a worker up to ``CACHE_WORDS`` words."""

    def __init__(self, trie: TrieCounter):
        self.trie = trie
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def batch(self, texts: pa.Array) -> list[pa.Array]:
        words, tokens = [], []
        for chunk in tb.chunks(texts, tb.WIDE_CHUNK_BYTES):
            found = tb.words(chunk)
            hashes, first, inverse = np.unique(tb.word_hashes(chunk, found), return_index=True, return_inverse=True)
            n_tokens = self._known(chunk, found, hashes, first)[inverse] if len(hashes) else np.zeros(0, np.int64)
            words.append(tb.counts(found.text, chunk.size))
            tokens.append(tb.counts(found.text, chunk.size, n_tokens))
        empty = [np.zeros(0, np.int64)]
        return [pa.array(np.concatenate(words or empty)), pa.array(np.concatenate(tokens or empty))]

    def _known(self, chunk: tb.Chunk, found: tb.Spans, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        counts = np.zeros(len(hashes), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = chunk.data.tobytes()
            text = [data[found.start[i] : found.end[i]].decode("utf-8", "replace") for i in first[new]]
            counted = self.trie.count(text)
            counts[new] = [counted[w] for w in text]
            if len(self.hashes) + len(new) > CACHE_WORDS:
                self.hashes, self.counts = hashes, counts
            else:
                merged = np.concatenate([self.hashes, hashes[new]])
                order = np.argsort(merged)
                self.hashes, self.counts = merged[order], np.concatenate([self.counts, counts[new]])[order]
        return counts


_LOADED: dict[tuple[str, int], _Counter] = {}


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``n_pretokens`` and ``n_tokens`` of every whole text. No shuffle.

    ``model_file`` is a path that every executor has; the pieces are sent with the tasks.
    """
    keep = [c for c in (keep or docs.columns) if c not in (text, "n_pretokens", "n_tokens")]
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))
    key = (model_file, pieces._jbroadcast.id())

    def count(texts: pa.Array) -> list[pa.Array]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = _Counter(TrieCounter(pieces.value))
        return _LOADED[key].batch(texts)

    return map_column(docs, text, keep, {"n_pretokens": "long", "n_tokens": "long"}, count)
