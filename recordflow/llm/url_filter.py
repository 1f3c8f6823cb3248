"""URL filters: rule lists looked up in cascades of Bloom filters.

A rule is a host, the start of a path and an action. It fits its host and all subdomains if the URL's path
starts with its path. Of the rules of one list that fit, the one with the longest ``host + path`` decides (of
equal ones that with more labels; a rule listed with both actions blocks); of several lists the first that fits.

A URL has one candidate key for each shape ``(labels, path length)`` that occurs in the list, so the keys it
could be listed under are known without the list. These keys of all URLs are the universe. Level 0 of a
cascade encodes the listed keys; level 1 those keys of the universe that pass level 0 without being listed;
level 2 the listed keys that pass level 1; and so on until no key is left over. Inside the universe the first
level that a key fails tells exactly whether it is listed. A second cascade over the listed keys tells
which of them block. URLs are judged against broadcast levels: no join, no shuffle of URLs. Only keys
that pass level 0 are ever shuffled, folded by task.

A list is cut by key hash into blocks of at most ``BLOCK_KEYS`` keys with a cascade each, so what is broadcast is
bounded whatever the list's size: rows meet one block at a time and are written in between.

A URL that is NULL or has no ``://`` has an empty host and path, and is judged like any other; NULL hosts or
actions in a list are no rules, a NULL path is empty. Repeated URLs and rules, very long URLs, empty tables and
empty lists need no care of the caller. Kept columns with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.textbytes import mix
from recordflow.storage import cut, cut_counted, scratch_path

BITS_PER_KEY = 10
HASHES = 6
BLOCK_KEYS = 4_000_000
MAX_LEVELS = 64

RESULTS = ["host", "path", "rule", "verdict", "listed"]

# Letters that are lower-cased in hosts.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands behind the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, action)`` as distinct keys with their shape, two hashes and whether they block."""
    host, path = F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    known = rules.where(F.col("host").isNotNull() & F.col("action").isin("allow", "block"))
    labels = F.size(F.split(host, "\\."))
    folded = known.groupBy(host.alias("host"), path.alias("path")).agg(F.max(F.col("action") == "block").alias("blocks"))
    return folded.select("host", "path", labels.alias("labels"), F.length("path").alias("chars"), *_hashes(F.col("host"), F.col("path")), "blocks")


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    """Two hashes of a key; together they stand for it."""
    return F.xxhash64(host, path).alias("a"), F.xxhash64(path, F.lit(7), host).alias("b")


def _positions(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    first, step = mix(a ^ mix(np.array([2 * level + 1], _U))), mix(b ^ mix(np.array([2 * level + 2], _U))) | _U(1)
    for k in range(HASHES):
        yield (first + _U(k) * step) % _U(bits)


def passes(words: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inside = np.ones(len(a), dtype=bool)
    for at in _positions(a, b, level, 64 * len(words)):
        inside &= (words[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1
    return inside


def contains(levels: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the keys are listed; exact for keys of the universe."""
    listed = np.zeros(len(a), dtype=bool)
    open_, last = np.arange(len(a)), len(levels) - 1
    for k, words in enumerate(levels):
        inside = passes(words, k, a[open_], b[open_])
        listed[open_[~inside]] = k % 2 == 1
        open_ = open_[inside]
    listed[open_] = last % 2 == 0
    return listed


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(_U)


def encode(keys: DataFrame, n: int, level: int) -> np.ndarray:
    """The words of a Bloom filter of ``n`` keys; tasks send words with the bits they have set."""
    size = max(1, -(-n * BITS_PER_KEY // 64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate([*_positions(_column(batch, "a"), _column(batch, "b"), level, 64 * size)]))
            if len(at):
                word, start = np.unique(at >> _U(6), return_index=True)
                value = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    found = keys.select("a", "b").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, dtype=_U)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(_U)
    return words


def passing(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    """The keys that pass a level."""
    held = keys.sparkSession.sparkContext.broadcast(words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(held.value, level, _column(batch, "a"), _column(batch, "b"))))

    return keys.mapInArrow(keep, keys.schema)


def cascade(listed: DataFrame, n: int, others: Callable[[np.ndarray], DataFrame]) -> list[np.ndarray]:
    """Levels for ``n`` listed keys ``(a, b)``; ``others`` gives the keys of the universe that pass level 0 and are not listed."""
    spark = listed.sparkSession
    levels = [encode(listed, n, 0)]
    wrong, seen = cut_counted(others(levels[0]), scratch_path(spark, "level"))
    behind = listed
    while seen["n"]:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("keys of both kinds share both hashes")
        levels.append(encode(wrong, seen["n"], len(levels)))
        left, seen = cut_counted(passing(behind, levels[-1], len(levels) - 1), scratch_path(spark, "level"))
        wrong, behind = left, wrong
    return levels


def _candidates(shapes: Sequence[tuple[int, int]]) -> Column:
    """Keys a URL may be listed under, by the shapes that its host and path reach."""
    each = ", ".join(f"named_struct('labels', {c}, 'chars', {n})" for c, n in shapes)
    host, path = "substring_index(host, '.', -s.labels)", "substring(path, 1, s.chars)"
    return F.expr(
        f"transform(filter(array({each}), s -> s.labels <= size(split(host, '[.]')) AND s.chars <= length(path)), s -> named_struct("
        f"'labels', s.labels, 'chars', s.chars, 'size', length({host}) + s.chars, 'a', xxhash64({host}, {path}), 'b', xxhash64({path}, 7, {host})))"
    )


def _better(size: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return (size.astype(np.int64) << 32) | labels.astype(np.int64)


def _block_of(a: np.ndarray, blocks: int) -> np.ndarray:
    return a % _U(blocks)


def _look(urls: DataFrame, levels: list[np.ndarray], blocking: list[np.ndarray], block: int, blocks: int) -> DataFrame:
    """``urls`` with ``best = (size, labels)``, ``chars`` and ``blocks`` of the longest listed key so far."""
    held = urls.sparkSession.sparkContext.broadcast((levels, blocking))
    names = urls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, blocking = held.value
        for batch in batches:
            keys = batch.column(names.index("keys"))
            offsets = keys.offsets.to_numpy()
            flat = keys.values.slice(offsets[0], offsets[-1] - offsets[0])
            part = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("labels", "chars", "size", "a", "b")}
            a, b = part["a"].view(_U), part["b"].view(_U)
            row = np.repeat(np.arange(len(keys)), np.diff(offsets))
            own = np.flatnonzero(_block_of(a, blocks) == block)
            own = own[contains(levels, a[own], b[own])]
            rank = _better(part["size"][own], part["labels"][own])
            own = own[np.lexsort((rank, row[own]))]
            last = np.flatnonzero(np.append(row[own][1:] != row[own][:-1], True)) if len(own) else own
            own = own[last]
            best, chars, blocked = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).copy() for c in ("best", "chars", "blocks"))
            rank = _better(part["size"][own], part["labels"][own])
            won = rank > best[row[own]]
            own, rank = own[won], rank[won]
            best[row[own]], chars[row[own]] = rank, part["chars"][own]
            blocked[row[own]] = contains(blocking, a[own], b[own])
            made = {"best": pa.array(best), "chars": pa.array(chars), "blocks": pa.array(blocked)}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)

    return urls.mapInArrow(run, urls.schema)


def _fit(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path, ...)`` with the longest rule that fits as ``fit`` and whether it blocks as ``blocks``; both NULL without one."""
    spark = urls.sparkSession
    listed, seen = cut_counted(rule_table(rules), scratch_path(spark, "rules"))
    shapes = sorted((r["labels"], r["chars"]) for r in listed.select("labels", "chars").distinct().collect())
    if not shapes:
        return urls.withColumns({"fit": F.lit(None).cast("string"), "blocks": F.lit(None).cast("boolean")})
    blocks = -(-seen["n"] // BLOCK_KEYS)
    start = {"best": F.lit(-1).cast("long"), "chars": F.lit(0), "blocks": F.lit(False)}
    state = urls.withColumns({**start, "keys": _candidates(shapes)})
    corpus = urls.select(F.explode(_candidates(shapes)).alias("key")).select("key.a", "key.b")
    for block in range(blocks):
        mine = _unsigned_mod(F.col("a"), blocks) == block
        keys, count = cut_counted(listed.where(mine), scratch_path(spark, "block"))

        def unlisted(level0: np.ndarray, keys: DataFrame = keys, mine: Column = mine) -> DataFrame:
            found = passing(corpus.where(mine), level0, 0).groupBy("a", "b").agg(F.lit(0).alias("listed"))
            both = found.unionByName(keys.select("a", "b", F.lit(1).alias("listed")))
            return both.groupBy("a", "b").agg(F.max("listed").alias("listed")).where("listed = 0").select("a", "b")

        levels = cascade(keys.select("a", "b"), count["n"], unlisted)
        yes, no = keys.where("blocks").select("a", "b"), keys.where("NOT blocks").select("a", "b")
        blocking = cascade(yes, yes.count(), lambda level0, no=no: passing(no, level0, 0))
        state = _look(state, levels, blocking, block, blocks)
        if block + 1 < blocks:
            state = cut(state, "judged")
    hit = F.col("best") >= 0
    labels = F.col("best").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    fit = F.concat(F.expr("substring_index(host, '.', -labels)"), F.expr("substring(path, 1, chars)"))
    out = state.withColumn("labels", labels).withColumns({"fit": F.when(hit, fit), "blocks": F.when(hit, F.col("blocks"))})
    return out.drop("best", "chars", "labels", "keys")


def _unsigned_mod(value: Column, n: int) -> Column:
    """``value`` as an unsigned number modulo ``n``, from its two halves."""
    high, low = F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit((1 << 32) - 1))
    return (high * F.lit((1 << 32) % n) + low) % F.lit(n)


def judge_urls(pages: DataFrame, rules: DataFrame, own: DataFrame, url: str = "url", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all), ``host``, ``path``, the rule of ``rules`` that decides or NULL, and ``verdict``.

    Where no rule fits, the list ``own`` decides (its key in ``listed``); what it does not list is allowed.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c not in RESULTS]
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    # Kept columns ride along in one struct, apart from the columns used here.
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0)]).alias("kept"), host.alias("host"), path.alias("path"))
    first = _fit(urls, rules).withColumnsRenamed({"fit": "rule", "blocks": "rule_blocks"})
    second = _fit(first, own).withColumnsRenamed({"fit": "listed", "blocks": "own_blocks"})
    blocks = F.coalesce("rule_blocks", "own_blocks", F.lit(False))
    verdict = F.when(blocks, "block").otherwise("allow")
    listed = F.when(F.col("rule").isNull(), F.col("listed"))
    return second.select(*[F.col("kept")[c].alias(c) for c in kept], "host", "path", "rule", verdict.alias("verdict"), listed.alias("listed"))


# Words that make a host suspect.
SUSPECT_WORDS = [
    "adult", "bet", "betting", "casino", "cheap", "crack", "escort", "farm", "keygen", "loan", "loans", "pharma", "pills", "poker", "porn", "replica",
    "sex", "slots", "spam", "viagra", "warez", "xxx",
]


def suspect_hosts(pages: DataFrame, url: str = "url", words: Sequence[str] = SUSPECT_WORDS) -> DataFrame:
    """Block rules for the hosts that have one of ``words`` between dots, hyphens and the like."""
    host, _ = host_and_path(F.col(f"`{url}`").cast("string"))
    hosts = pages.select(host.alias("host")).where(F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*map(F.lit, words))))
    return hosts.distinct().select("host", F.lit("").alias("path"), F.lit("block").alias("action"))
