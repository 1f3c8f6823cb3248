"""Quality rules by document and by host.

Each document is measured in one pass. Rule failures are added up by host, the failure rate of
a host is shrunk towards all hosts by a beta prior fitted to them, and the verdict of the host
goes back to its documents.

NULL texts count as empty; a NULL host is a host of its own; repeated rows are measured and
counted one by one; an empty table gives an empty result. Extra columns stay, apart from those
with the names of the results, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm import textbytes as tb
from recordflow.llm.tables import map_column
from recordflow.storage import cut, sized

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _measure_chunk(chunk: tb.Chunk) -> np.ndarray:
    n, data = chunk.size, chunk.data
    found = tb.words(chunk)
    hasher = tb.SpanHasher(data)
    first_bytes = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_FIRST_BYTE[data], out=first_bytes[1:])
    chars = first_bytes[found.end] - first_bytes[found.start]
    symbols = tb.counts(tb.text_of(chunk, np.flatnonzero(_SYMBOL[data])), n)

    rows = tb.lines(chunk)
    has_word = np.searchsorted(found.start, rows.end) > np.searchsorted(found.start, rows.start)
    line_text, line_hash = rows.text[has_word], hasher(rows.start[has_word], rows.end[has_word])
    order = np.lexsort((line_hash, line_text))
    same = (line_text[order][1:] == line_text[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    dup_lines = tb.counts(line_text[order][1:][same], n)

    value, at = tb.windows(hasher(found.start, found.end), found.text, WINDOW)
    order = np.lexsort((value, found.text[at]))
    value, text, place = value[order], found.text[at][order], at[order]
    same = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
    again = np.zeros(len(value), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    cover = np.zeros(len(found) + 1, dtype=np.int64)
    np.add.at(cover, place[again], 1)
    np.add.at(cover, place[again] + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    return np.stack([
        tb.counts(found.text, n), tb.counts(found.text, n, chars), symbols, dup_lines,
        tb.counts(found.text[repeated], n),
    ])


def measure_batch(texts: pa.Array) -> list[pa.Array]:
    parts = [_measure_chunk(c) for c in tb.chunks(texts)]
    table = np.concatenate(parts, axis=1) if parts else np.zeros((len(MEASURES), 0), np.int64)
    return [pa.array(column) for column in table]


def measure(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with the measures of the text column; the text itself goes no further."""
    return map_column(docs, text, keep, {name: "long" for name in MEASURES}, measure_batch)


def fails() -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_rates(hosts: DataFrame) -> DataFrame:
    """``(host, n, failed)`` with the shrunk rate ``(failed + a) / (n + a + b)``.

    ``a`` and ``b`` are fitted to the hosts' rates by their mean and variance (method of moments);
    the prior never weighs less than one document nor more than the mean host.
    """
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
        F.coalesce(F.avg("n"), F.lit(1.0)).alias("most"),
    )
    found = prior.first()
    m, v, most = float(found["m"]), float(found["v"]), max(1.0, float(found["most"]))
    weight = m * (1 - m) / v - 1 if v > 0 else most
    weight = min(max(weight, 1.0), most)
    return hosts.withColumn("rate", (F.col("failed") + m * weight) / (F.col("n") + weight))


def host_verdicts(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None,
                  max_rate: float = 0.5) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document.

    A document is kept if it passes the rules itself and the shrunk failure rate of its host
    is at most ``max_rate``. Measures are written once; they and not the texts are shuffled.
    Failures are added up before the shuffle, so a large host is one row of each task.
    """
    keep = [c for c in (keep or docs.columns) if c not in [*MEASURES, "base_failed", "kept", text]]
    table = docs.withColumn("__host", F.col(f"`{host}`"))
    measured = cut(measure(table, text, [*keep, "__host"]).withColumn("base_failed", fails()), "host-rules")
    hosts = measured.groupBy("__host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    hosts = cut(hosts, "hosts")
    bad = sized(host_rates(hosts).where(F.col("rate") > max_rate).select(F.col("__host").alias("__bad_host")), "bad-hosts")
    marked = measured.join(bad.withColumn("__bad", F.lit(True)), F.col("__host").eqNullSafe(F.col("__bad_host")), "left")
    kept = ~F.col("base_failed") & F.col("__bad").isNull()
    return marked.withColumn("kept", kept).drop("__host", "__bad_host", "__bad")
