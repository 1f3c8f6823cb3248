"""Quality classifier: boosted trees over statistics of whole documents.

Learning reads labels of rows outside the held-out fold only, at most ``max_rows`` of them (those
with the smallest hash of their id), so what reaches the driver is bounded by that parameter.
Scoring is one pass over the texts without a shuffle.

NULL texts count as empty and are scored like any other; a NULL id is never held out nor learnt
from; a repeated id is scored row by row and learnt once; without labels of both classes every
score is the smoothed share of class 1. Language, source, id and labels are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm import textbytes as tb
from recordflow.llm.boosting import Forest, fit
from recordflow.llm.tables import map_column

MAX_TRAINING_ROWS = 20_000
MIN_SCORE = 0.3
FOLDS = 5

RESULTS = ["held_out", "score", "predicted"]

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>@=_{}[]\\^~+", "pipe": b"|",
    "excited": b"!?", "stop": b".", "comma": b",;:", "blank": b" \t\n\v\f\r", "newline": b"\n",
}
_TABLES = {name: np.isin(np.arange(256), list(chars)) for name, chars in _SETS.items()}
_WIDE = np.arange(256) >= 0x80


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _chunk_features(chunk: tb.Chunk) -> np.ndarray:
    n, data = chunk.size, chunk.data
    size = np.diff(chunk.offsets)
    found = tb.words(chunk)
    hashes = tb.word_hashes(chunk, found)
    n_words = tb.counts(found.text, n)
    length = found.end - found.start

    def bytes_in(table: np.ndarray) -> np.ndarray:
        return tb.counts(tb.text_of(chunk, np.flatnonzero(table[data])), n)

    def words_with(mask: np.ndarray) -> np.ndarray:
        return _ratio(tb.counts(found.text[mask], n), n_words)

    last, first = data[found.end - 1], data[found.start]
    upper = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_TABLES["upper"][data], out=upper[1:])
    capitals = upper[found.end] - upper[found.start]
    same = np.zeros(len(found), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (found.text[1:] == found.text[:-1])
    order = np.lexsort((hashes, found.text))
    h, t = hashes[order], found.text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    value, at = tb.windows(hashes, found.text, 3)
    text = found.text[at]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new_window = np.ones(len(value), dtype=bool)
    new_window[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    rows = tb.lines(chunk)
    widest = np.zeros(n, dtype=np.int64)
    np.maximum.at(widest, rows.text, rows.end - rows.start)
    letters = np.maximum(size - bytes_in(_TABLES["blank"]), 1)
    columns = [
        np.log1p(n_words), np.log1p(size), _ratio(tb.counts(found.text, n, length), n_words),
        _ratio(tb.counts(found.text, n, length * length), n_words),
        *[bytes_in(_TABLES[k]) / letters for k in ("upper", "digit", "symbol", "pipe", "excited", "stop", "comma")],
        bytes_in(_WIDE) / letters, _ratio(bytes_in(_TABLES["newline"]), n_words), bytes_in(_TABLES["blank"]) / np.maximum(size, 1),
        words_with(_TABLES["symbol"][last]), words_with(_TABLES["excited"][last]), words_with(_TABLES["upper"][first]),
        words_with((capitals == length) & (length > 1)), words_with((capitals * 2 >= length) & (length > 2)),
        words_with(same), _ratio(tb.counts(t[new], n), n_words),
        _ratio(tb.counts(text[new_window], n), tb.counts(text, n)), _ratio(widest, size),
    ]
    return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)


N_FEATURES = 23


def features(texts: pa.Array) -> np.ndarray:
    parts = [_chunk_features(c) for c in tb.chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def held_out(doc_id: Column) -> Column:
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Forest:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one_each = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__label"))
    # At most max_rows rows of two numbers, so the sort of each task, and the broadcast, are bounded.
    sample = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(sample), "doc_id")

    def measure(column: pa.Array) -> list[pa.Array]:
        return [pa.array(list(features(column)), pa.list_(pa.float64()))]

    rows = (
        map_column(texts, "__text", ["doc_id", "__label"], {"x": "array<double>"}, measure)
        .groupBy("doc_id").agg(F.min(F.struct("x", "__label")).alias("r")).select("doc_id", "r.*").collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]).reshape(len(rows), N_FEATURES)
    return fit(x, np.array([r["__label"] for r in rows]))


def classify(docs: DataFrame, model: Forest, keep: list[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """``keep`` columns with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``min_score`` on)."""
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULTS]

    def score(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.scores(features(texts)))]

    scored = map_column(docs, "text", keep, {"score": "double"}, score)
    return scored.select(
        *[F.col(f"`{c}`") for c in keep], held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= min_score).cast("int").alias("predicted"),
    )
