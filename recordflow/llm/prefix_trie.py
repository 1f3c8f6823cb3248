"""Trie of the prefixes that conversations share, as a burst trie of distributed containers.

A container holds the suffixes of all conversations below one node of the trie's head; at first the root's
holds everything. A container of more than ``LIMIT`` turns bursts: the turns that all its suffixes
begin with become a chain of head nodes, and the suffixes are dealt by their next turn into the containers of its
children. Bursting goes on, all containers at once, until none is too large. The remaining containers are dealt
over the cluster and each is sorted and swept in one pass that opens and closes nodes along the common prefixes of
neighbours. A container of one conversation is a path and needs neither, however long it is. Totals of
subtrees are added up from the containers to the root, a table of head nodes for each burst.

A node is known by its depth and the least conversation below it. Turns are compared by two 64-bit hashes of role and
text. What a task holds at once is one container of at most ``LIMIT`` turns; a conversation or a group of copies that
holds a third of all turns is folded by task, or split by Spark where it is joined.

Turns stand in the order of ``turn``, NULL first, ties by the hashes; repeated turns are turns of their own. NULL roles
and texts are empty. Conversations have whole numbers as ids; turns without ``conv_id`` belong to no conversation and are left out. Texts of any length count
whole and only their hashes and lengths are moved. An empty table has no nodes. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordflow.llm.tables import numbered
from recordflow.storage import cut, cut_counted, scratch_path, sized

LIMIT = 50_000
BURST, SWEEP, SINGLE = "burst", "sweep", "single"
NODE = "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
END = "depth int, conv_id long, member long"
_NODE = [f.split()[0] for f in NODE.split(", ")]
_END = [f.split()[0] for f in END.split(", ")]
_HEAD = ["hd", "hc"]

# Rows of a chain that are added up in one piece.
BLOCK = 4096
# Ids of a node that are joined in one piece.
PIECE = 65_536


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, t1, t2, weight)`` of every turn, numbered from 1, and ``(conv_id, n)`` of every conversation.

    ``weight`` is the text's length in code points.
    """
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    table = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.xxhash64(who, said).alias("t1"),
        F.xxhash64(said, F.lit(11), who).alias("t2"), F.length(said).cast("long").alias("weight"))
    table = numbered(table, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], "place")
    convs = cut(table.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).cast("int").alias("n")), "conversations")
    placed = table.join(convs, "conv_id").select("conv_id", (F.col("place") - F.col("first") + 1).cast("int").alias("depth"), "t1", "t2", "weight")
    return cut(placed, "turns"), convs.select("conv_id", "n")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _kind(n_convs, below):
    return F.when(n_convs == 1, SINGLE).when(below <= LIMIT, SWEEP).otherwise(BURST)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of numbered turns and their conversations (which may have no turns).

    Nodes: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless
    nodes of the subtree) and ``saved_tokens`` (``(n_convs - 1) * weight``, summed over the subtree). Ends: the node
    ``(depth, conv_id)`` that each ``member`` is spelled out at.
    """
    spark = turns.sparkSession
    root = convs.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("below")).first()
    if not root["n"]:
        return spark.createDataFrame([], NODE), spark.createDataFrame([], END)
    kind = SINGLE if root["n"] == 1 else SWEEP if root["below"] <= LIMIT else BURST
    top = spark.createDataFrame(
        [(0, root["conv"], None, root["n"], 0, root["below"], kind, -1, -1)],
        "depth int, conv long, parent long, n_convs long, weight long, below long, kind string, hd int, hc long")
    # The root's container; as plain literals these would be folded out of the joins on them.
    held = F.col("conv_id").isNotNull()
    place = {"hd": F.when(held, F.lit(0)), "hc": F.when(held, F.lit(root["conv"]).cast("long")), "kind": F.lit(kind)}
    members = convs.select("conv_id", "n").withColumns(place)
    rows = turns.select("conv_id", F.col("depth").cast("int").alias("depth"), "t1", "t2", "weight").withColumns(place)

    rounds, kept_rows, kept_members, ends = [], [], [], []
    while True:
        kept_rows.append(rows.where(F.col("kind") != BURST))
        kept_members.append(members.where(F.col("kind") != BURST))
        if kind != BURST:
            break
        one = _burst(rows.where(F.col("kind") == BURST), members.where(F.col("kind") == BURST))
        rounds.append(one)
        ends.append(one["ends"])
        rows, members = one["rows"], one["members"]
        kind = BURST if one["bursts"] else SWEEP

    kept = _union(kept_members)
    swept = cut(_sweep(_union(kept_rows).where(F.col("kind") == SWEEP)), "swept")
    inner = swept.where("member IS NULL")
    singles = _union(kept_rows).where(F.col("kind") == SINGLE).join(
        kept.where(F.col("kind") == SINGLE).select("conv_id", "n"), "conv_id")
    own = F.col("conv_id")
    paths = singles.select(
        "depth", own.alias("conv_id"), own.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    ends += [
        swept.where("member IS NOT NULL").select("depth", "conv_id", "member"),
        kept.where(F.col("kind") == SINGLE).select(F.col("n").alias("depth"), own.alias("conv_id"), own.alias("member")),
        kept.where((F.col("kind") == SWEEP) & (F.col("n") == F.col("hd"))).select(F.col("hd").alias("depth"), F.col("hc").alias("conv_id"), own.alias("member")),
    ]

    # Totals below each container's node, from the leaves to the root.
    totals = inner.where(F.col("depth") == F.col("hd") + 1).groupBy("hd", "hc").agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    totals = cut(totals, "totals")
    nodes = [inner.select(*_NODE), paths]
    for one in reversed(rounds):
        children = _with_totals(one["children"], totals)
        chain, above = _chains(one, children)
        nodes += [children.select(*_NODE), chain]
        totals = cut(totals.unionByName(above), "totals")
    nodes.append(_with_totals(top, totals).select(*_NODE))
    return _union(nodes), _union(ends).select(F.col("depth").cast("int").alias("depth"), "conv_id", "member")


def _burst(rows: DataFrame, members: DataFrame) -> dict:
    """One burst of all given containers: chain and children of each, and its suffixes in the children's containers."""
    spark = rows.sparkSession
    sizes = members.groupBy(*_HEAD).agg(F.count(F.lit(1)).alias("m"))
    levels = rows.groupBy(*_HEAD, "depth").agg(
        F.count(F.lit(1)).alias("k"), F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("t2").alias("c"), F.max("t2").alias("d"), F.max("weight").alias("weight"))
    same = (F.col("k") == F.col("m")) & (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    levels = cut(levels.join(sizes, _HEAD).select(*_HEAD, "depth", "m", "weight", same.alias("same")), "levels")
    # Where the suffixes of a container part; behind the last turn if they are all alike.
    parting = F.coalesce(F.min(F.when(~F.col("same"), F.col("depth"))), F.max("depth") + 1)
    bounds = sized(levels.groupBy(*_HEAD).agg(parting.alias("parting")), "bounds")

    open_rows = rows.select("hd", "hc", "conv_id", "depth", "t1", "t2", "weight").join(bounds, _HEAD).where(F.col("depth") >= F.col("parting"))
    lasting = members.select("hd", "hc", "conv_id", "n").join(bounds, _HEAD)
    parted = open_rows.where(F.col("depth") == F.col("parting")).join(members.select("conv_id", "n"), "conv_id")
    parted = cut(parted.select(*_HEAD, "conv_id", "depth", "t1", "t2", "weight", "n"), "parted")
    n_convs, below = F.count(F.lit(1)), F.sum(F.col("n") - F.col("depth"))
    children = parted.groupBy(*_HEAD, "depth", "t1", "t2").agg(
        F.min("conv_id").alias("conv"), n_convs.alias("n_convs"), F.max("weight").alias("weight"), below.cast("long").alias("below"))
    children = children.withColumns({"kind": _kind(F.col("n_convs"), F.col("below")), "parent": F.col("hc")})
    children, seen = cut_counted(children, scratch_path(spark, "children"), bursts=F.sum((F.col("kind") == BURST).cast("long")))
    to = children.select(*_HEAD, "t1", "t2", F.col("conv").alias("nc"), "kind")
    dealt = cut(parted.join(to, [*_HEAD, "t1", "t2"]).select(F.col("depth").alias("hd"), F.col("nc").alias("hc"), "conv_id", "n", "kind"), "members")
    moved = open_rows.select("conv_id", "depth", "t1", "t2", "weight").join(dealt.select("conv_id", "hd", "hc", "kind"), "conv_id").where(F.col("depth") > F.col("hd"))
    return {
        "levels": levels, "bounds": bounds, "children": children, "bursts": seen["bursts"], "members": dealt, "rows": cut(moved, "suffixes"),
        "ends": lasting.where(F.col("n") < F.col("parting")).select(F.col("n").alias("depth"), F.col("hc").alias("conv_id"), F.col("conv_id").alias("member")),
    }


def _with_totals(heads: DataFrame, totals: DataFrame) -> DataFrame:
    """Head nodes ``(hd, hc, depth, conv, parent, n_convs, weight, below, kind)`` as nodes, from the totals below them."""
    found = totals.select(F.col("hd").alias("depth"), F.col("hc").alias("conv"), "children", "leaves", "saved")
    single = F.col("kind") == SINGLE
    children = F.when(single, (F.col("below") > 0).cast("long")).otherwise(F.coalesce("children", F.lit(0)))
    saved = (F.col("n_convs") - 1) * F.col("weight") + F.coalesce("saved", F.lit(0))
    return heads.join(found, ["depth", "conv"], "left").select(
        *_HEAD, "depth", F.col("conv").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", children.alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"))


def _chains(one: dict, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that lie between the burst containers' nodes and their children, and the totals below the former."""
    sums = children.groupBy(*_HEAD).agg(F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    bottom = cut(one["bounds"].join(sums, _HEAD, "left").select(
        *_HEAD, "parting", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")), "bottom")
    chain = one["levels"].join(bottom, _HEAD).where(F.col("depth") < F.col("parting"))
    chain = chain.withColumns({"own": (F.col("m") - 1) * F.col("weight"), "block": F.floor(F.col("depth") / BLOCK)})
    # Sums from a node to the chain's end: those of whole blocks behind it and of the rest of its block.
    parts = chain.groupBy(*_HEAD, "block").agg(F.sum("own").alias("part"))
    behind = Window.partitionBy(*_HEAD).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*_HEAD, "block", F.coalesce(F.sum("part").over(behind), F.lit(0)).alias("later"))
    rest = Window.partitionBy(*_HEAD, "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    chain = chain.withColumn("run", F.sum("own").over(rest)).join(parts, [*_HEAD, "block"])
    last = F.col("depth") + 1 == F.col("parting")
    nodes = chain.select(
        "depth", F.col("hc").alias("conv_id"), F.col("hc").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.when(last, F.col("k")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("run") + F.col("later") + F.col("saved")).alias("saved_tokens"))
    added = chain.groupBy(*_HEAD).agg(F.sum("own").alias("own"))
    above = bottom.join(added, _HEAD, "left").select(
        *_HEAD, F.when(F.col("own").isNull(), F.col("k")).otherwise(1).alias("children"), "leaves", (F.col("saved") + F.coalesce("own", F.lit(0))).alias("saved"))
    return nodes, above


class _Open:
    """A node of the sweep whose suffixes are not all seen."""

    __slots__ = ("below", "conv", "ends", "inner", "leaves", "n", "weight")

    def __init__(self, weight: int):
        self.conv, self.n, self.leaves, self.below, self.weight, self.ends, self.inner = None, 0, 0, 0, weight, [], []


def sweep(hd: int, hc: int, suffixes: list[tuple[list[tuple[int, int]], list[int], int]]) -> Iterator[tuple]:
    """Nodes and ends of one container; suffixes are ``(turns, weights, conversation)`` and not empty.

    Gives ``(depth, conversation, parent, members, children, leaves, saved, NULL)`` for a node and
    ``(depth, conversation, NULL ..., member)`` for an end.
    """
    suffixes.sort(key=lambda s: (s[0], s[2]))
    top = _Open(0)
    stack, before = [top], []

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), hd + len(stack)
        parent = stack[-1]
        leaves = node.leaves or 1
        saved = node.below + (node.n - 1) * node.weight
        for child in node.inner:
            yield (depth + 1, child[0], node.conv, *child[1:], None)
        for member in node.ends:
            yield (depth, node.conv, None, None, None, None, None, member)
        parent.inner.append((node.conv, node.n, len(node.inner), leaves, saved))
        parent.n, parent.leaves, parent.below = parent.n + node.n, parent.leaves + leaves, parent.below + saved
        parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)

    for turns, weights, conv in suffixes:
        shared = 0
        while shared < len(before) and turns[shared] == before[shared]:
            shared += 1
        while len(stack) > shared + 1:
            yield from close()
        for weight in weights[shared:]:
            stack.append(_Open(weight))
        last = stack[-1]
        last.n += 1
        last.conv = conv if last.conv is None else min(last.conv, conv)
        last.ends.append(conv)
        before = turns
    while len(stack) > 1:
        yield from close()
    for child in top.inner:
        yield (hd + 1, child[0], hc, *child[1:], None)


def _sweep(rows: DataFrame) -> DataFrame:
    """Nodes, and ends as rows with a ``member``, of containers dealt over the cluster."""
    schema = f"hd int, hc long, {NODE}, member long"
    names = ["hd", "hc", *_NODE, "member"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * (len(names) - 3)]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, suffixes, out = None, [], []
        for got in batches:
            for hd, hc, conv, t1, t2, weight in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if (hd, hc) != head:
                    if suffixes:
                        out += [(*head, *x) for x in sweep(*head, suffixes)]
                    head, suffixes = (hd, hc), []
                if not suffixes or suffixes[-1][2] != conv:
                    suffixes.append(([], [], conv))
                suffixes[-1][0].append((t1, t2))
                suffixes[-1][1].append(weight)
            if len(out) >= BLOCK:
                yield batch(out)
                out = []
        if suffixes:
            out += [(*head, *x) for x in sweep(*head, suffixes)]
        if out:
            yield batch(out)

    dealt = rows.repartition(*_HEAD).sortWithinPartitions(*_HEAD, "conv_id", "depth")
    return dealt.select("hd", "hc", "conv_id", "t1", "t2", "weight").mapInArrow(run, schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, conv_id, ends_sha256)``: SHA-256 of each node's members in order, comma-joined, for nodes that have some.

    Members are sorted by range over the whole cluster and joined in pieces of at most ``PIECE``; only a node's pieces
    meet in a task, which hashes them one behind the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def joined() -> tuple:
            return (*node, ids[0], ",".join(map(str, ids)))

        for got in batches:
            for depth, conv, member in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if ids and ((depth, conv) != node or len(ids) == PIECE):
                    out.append(joined())
                    ids = []
                node = (depth, conv)
                ids.append(member)
            if out:
                yield _rows(out, [pa.int32(), pa.int64(), pa.int64(), pa.string()], ["depth", "conv_id", "first", "piece"])
                out = []
        if ids:
            yield _rows([joined()], [pa.int32(), pa.int64(), pa.int64(), pa.string()], ["depth", "conv_id", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for got in batches:
            for depth, conv, piece in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if (depth, conv) == node:
                    state.update(b"," + piece.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, conv), hashlib.sha256(piece.encode())
            if out:
                yield _rows(out, [pa.int32(), pa.int64(), pa.string()], ["depth", "conv_id", "ends_sha256"])
                out = []
        if node is not None:
            yield _rows([(*node, state.hexdigest())], [pa.int32(), pa.int64(), pa.string()], ["depth", "conv_id", "ends_sha256"])

    joined = ends.select(*_END).sort(*_END).mapInArrow(pieces, "depth int, conv_id long, first long, piece string")
    dealt = joined.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first")
    return dealt.select("depth", "conv_id", "piece").mapInArrow(digests, "depth int, conv_id long, ends_sha256 string")


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
