"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a random order that depends on their ids alone, and repeated up to
``max_repeats`` times. A document's virtual finish time is the number of its source's words up to
and with it, divided by the source's target. The document that its source's target ends in is cut there, so a source is
served to the word whatever the length of its documents. All of these pieces are range-sorted by their finish time and
the mix is cut where the budget, the size of all documents, is used up.

Cumulative words come from two levels: sums by (source, bucket of the order), and running sums
inside a bucket. A bucket holds about the square root of the number of rows, whatever the
share of its source. Only built-in functions run.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+`` in its whole text, however long; NULL and empty texts have none and
are never taken. Sources are weighed 1, 2, 3, repeating, in code point order with NULL last. Targets
stop at ``max_repeats`` times the source's size, the excess is shared anew. Repeated rows are
documents of their own. An empty table gives an empty result; input columns with the names of results
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.llm.tables import numbered, running_parts
from recordflow.storage import broadcast_if_small, cut

SEED = 20_240_501
MAX_REPEATS = 3
LEAST_BUCKET = 256
WORD = r"[^\x20\x09-\x0D]+"

RESULTS = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(__source, source_size, __rank, target)`` from ``(__source, source_size)``.

    The level is raised until no target is above its limit; each round is one aggregate.
    """
    ranked = numbered(sources, [F.col("__source").asc_nulls_last()], "__rank")
    weight, limit = F.col("__rank") % 3 + 1, F.col("source_size") * max_repeats
    budget = ranked.agg(F.sum("source_size").alias("b")).first()["b"] or 0
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * weight >= limit
        found = ranked.agg(
            F.sum(F.when(~over, weight)).alias("w"), F.sum(F.when(over, limit)).alias("c"), F.sum(over.cast("long")).alias("n")
        ).first()
        if not found["w"] or found["n"] == full:
            break
        level, full = (budget - (found["c"] or 0)) / found["w"], found["n"]
    target = F.when(F.lit(level) * weight >= limit, limit.cast("double")).otherwise(F.lit(level) * weight)
    return ranked.withColumn("target", target)


def mix(docs: DataFrame, keep: list[str] | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """``keep`` columns of every document with ``size``, ``source_size``, ``target`` and ``taken`` words."""
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULTS]
    n_rows = docs.count()
    buckets = max(1, n_rows // max(LEAST_BUCKET, int(n_rows**0.5)))
    table = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__source"), word_count(F.col(f"`{text}`")).alias("size"),
        F.col(f"`{doc_id}`").alias("__id"),
    )
    table = table.withColumn("__order", F.xxhash64(F.lit(seed), "__id", "size"))
    table = table.withColumn("__bucket", F.pmod("__order", F.lit(buckets)))
    if text not in keep:
        table = cut(table, "sizes")  # so that words are counted once
    sums = cut(table.groupBy("__source", "__bucket").agg(F.sum("size").alias("n")), "bucket-sizes")
    sources = targets(sums.groupBy("__source").agg(F.sum("n").alias("source_size")), max_repeats)
    sources = broadcast_if_small(cut(sources, "targets"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__source", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = table.withColumn("__inside", F.sum("size").over(inside))
    placed = _join_source(placed, starts.withColumnRenamed("__bucket", "__b"), F.col("__bucket") == F.col("__b"))
    placed = _join_source(placed, sources)
    columns = [*keep, "size", "source_size", "target", "__rank", (F.col("__start") + F.col("__inside")).alias("__sum")]
    placed = cut(placed.select(*[F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]), "mix")
    stop = _stop(placed, max_repeats)
    taken = F.lit(0).cast("long")
    if stop is not None:
        last = _key(F.lit(stop["time"]), F.lit(stop["rank"]).cast("long"), F.lit(stop["sum"]).cast("long"))
        for turn in range(max_repeats):
            for piece in _pieces(F.lit(turn)):
                taken = taken + F.when(_key(piece["time"], F.col("__rank"), piece["sum"]) <= last, piece["words"]).otherwise(0)
        taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return placed.withColumn("taken", taken).select(*[F.col(f"`{c}`") for c in [*keep, *RESULTS]])


def _join_source(left: DataFrame, right: DataFrame, also: Column | None = None) -> DataFrame:
    right = right.withColumnRenamed("__source", "__s")
    same = F.col("__source").eqNullSafe(F.col("__s"))
    return left.join(right, same if also is None else same & also).drop("__s")


def _pieces(turn: Column) -> list[dict[str, Column]]:
    """A document in one repeat of its source, cut where the source's target ends: words, finish time and words up to there."""
    before = turn * F.col("source_size") + F.col("__sum") - F.col("size")
    inside = F.greatest(F.least(F.floor("target") - before, F.col("size")), F.lit(0)).cast("long")
    ends = [(inside, before + inside), (F.col("size") - inside, before + F.col("size"))]
    return [{"words": words, "time": total / F.col("target"), "sum": total} for words, total in ends]


def _key(time: Column, rank: Column, total: Column) -> Column:
    return F.struct(time.alias("time"), rank.alias("rank"), total.alias("sum"))


def _stop(placed: DataFrame, max_repeats: int):
    """Key of the last piece within the budget; NULL if there is none."""
    turns = placed.where(F.col("size") > 0).select(
        F.explode(F.array(*[F.lit(k) for k in range(max_repeats)])).alias("turn"), "size", "source_size", "target", "__rank", "__sum")
    pieces = F.array(*[F.struct(*[value.alias(name) for name, value in piece.items()]) for piece in _pieces(F.col("turn"))])
    queue = turns.select(F.col("__rank").alias("rank"), F.inline(pieces)).where("words > 0")
    queue = queue.select("time", "rank", "sum", F.col("words").alias("size"))
    budget = placed.agg(F.sum("size").alias("b")).first()["b"] or 0
    return running_parts(queue, ["time", "rank", "sum"], "size", budget)
