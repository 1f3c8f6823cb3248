"""Graph operators on an edge table ``(src, dst[, kind])``: ``dst`` requires ``src``.

Loops work on written tables, so the lineage of a long loop stays flat. Edges are written once by bucket of
the node they are followed from, sorted in it; a round reads only the buckets its frontier is in, and the known size of the frontier
lets Spark broadcast it while it is small and shuffle it once it is not, with AQE splitting a node that holds a large
part of the edges.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.storage import cut, cut_counted, cut_observed, scratch_path

REQUIRES, DEPENDS = "requires", "depends"

# Edges of a bucket, about, and the most buckets there are.
BUCKET_EDGES, MOST_BUCKETS = 250_000, 1024
# Rounds of one step before paths are doubled, and how far the paths of a length may outnumber the edges.
NEAR_ROUNDS, PATH_GROWTH = 4, 2
# Pairs that no shuffle deals out stay in the file of the task that found them, which the next level reads in pieces of this size.
PAIR_ROW_GROUP = 4 * 1024 * 1024


class CyclicLineage(ValueError):
    """Requirements that form a cycle."""


def required(edges: DataFrame) -> DataFrame:
    """The requirement edges alone, as distinct ``(src, dst)``."""
    if "kind" in edges.columns:
        edges = edges.where(F.col("kind") == REQUIRES)
    return edges.select("src", "dst").distinct()


def _bucket(node: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


class _Layout:
    """Edges ``(front, back, ...)`` in buckets of their front node."""

    def __init__(self, edges: DataFrame, n_edges: int, path: str):
        self.buckets = max(1, min(MOST_BUCKETS, -(-n_edges // BUCKET_EDGES)))
        self.path, self.schema = path, edges.schema
        if self.buckets == 1:
            self.table = cut(edges, path=path)
            return
        # Rebalancing splits the bucket of a node with a large part of the edges.
        dealt = edges.withColumn("bucket", _bucket("front", self.buckets)).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "front").write.partitionBy("bucket").parquet(path)
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        self.table = edges.sparkSession.read.schema(schema).parquet(path)

    def of(self, buckets: Iterable[int] | None) -> DataFrame:
        """The edges of some buckets; the folders of others are not read."""
        names = self.schema.names
        if self.buckets == 1 or buckets is None or len(set(buckets)) == self.buckets:
            return self.table.select(*names)
        return self.table.where(F.col("bucket").isin(sorted(set(buckets)))).select(*names)

    def bucket_set(self, node: Column) -> Column:
        """Aggregate: the buckets that nodes are in, NULLs left out."""
        return F.collect_set(F.when(node.isNotNull(), _bucket(node, self.buckets)))


def _settle(edges: DataFrame, path: str, front: str, back: str, n_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds that settle the nodes all of whose edges from ``front`` come from settled nodes.

    Every edge is followed once, in the round after its front node is settled. An edge carries how many its back node
    waits for, so a node that gets them all in one round is settled there and then. For others the rounds that touched
    them are added up, from the buckets of such nodes alone. What a round writes are the nodes it touches and
    those that are settled late. Returns ``(node, level)`` of the settled nodes, each once, and ``(node)`` of the others: a cycle and what
    lies behind it. ``n_edges`` is given for edges that are a written table, which is then not written again.
    """
    spark = edges.sparkSession
    raw = edges.select(F.col(front).alias("front"), F.col(back).alias("back"))
    if n_edges is None:
        raw, size = cut_counted(raw, f"{path}/edges")
        n_edges = size["n"]
    need = cut(raw.groupBy("back").agg(F.count(F.lit(1)).alias("need")), path=f"{path}/need")
    layout = _Layout(raw.join(need, "back").select("front", "back", "need"), n_edges, f"{path}/layout")
    node_type = raw.schema["front"].dataType
    ready, waits = F.col("got") == F.col("need"), F.col("got") < F.col("need")
    free = raw.select(F.col("front").alias("node")).distinct().join(need.withColumnRenamed("back", "node"), "node", "left_anti")
    frontier, found = cut_observed(free, f"{path}/free", n=F.count(F.lit(1)), buckets=layout.bucket_set(F.col("node")))
    settled, level, late = [frontier.select("node", F.lit(0).cast("long").alias("level"))], 0, False
    touched_type = T.StructType().add("node", node_type).add("got", "long").add("need", "long").add("level", "long").add("bucket", "integer")
    while found["n"]:
        level += 1
        followed = layout.of(found["buckets"]).join(frontier.select(F.col("node").alias("front")), "front")
        got = followed.groupBy(F.col("back").alias("node"), "need").agg(F.count(F.lit(1)).alias("got"))
        got = got.select("node", "got", "need", _bucket("node", layout.buckets).alias("bucket"))
        whole, part = F.when(ready, F.col("node")), F.when(waits, F.col("node"))
        touched, found = cut_observed(
            got, f"{path}/touched/level={level}", by="bucket" if layout.buckets > 1 else None,
            n=F.count_if(ready), buckets=layout.bucket_set(whole), waiting=layout.bucket_set(part))
        frontier = touched.where(ready).select("node")
        if not found["waiting"]:
            continue
        rest = touched.where(waits).select("node")
        all_rounds = spark.read.schema(touched_type).parquet(f"{path}/touched")
        if layout.buckets > 1:
            all_rounds = all_rounds.where(F.col("bucket").isin(sorted(found["waiting"])))
        sums = all_rounds.where(waits).join(rest, "node", "left_semi").groupBy("node", "need").agg(F.sum("got").alias("got"))
        more, ended = cut_observed(
            sums.where(ready).select("node"), f"{path}/late/level={level}", n=F.count(F.lit(1)), buckets=layout.bucket_set(F.col("node")))
        late = True
        frontier = frontier.union(more)
        found = {"n": found["n"] + ended["n"], "buckets": [*found["buckets"], *ended["buckets"]]}
    # Every round's nodes, from the folders the rounds wrote.
    if level:
        settled.append(spark.read.schema(touched_type).parquet(f"{path}/touched").where(ready).select("node", "level"))
    if late:
        late_type = T.StructType().add("node", node_type).add("level", "long")
        settled.append(spark.read.schema(late_type).parquet(f"{path}/late").select("node", "level"))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out, need.select(F.col("back").alias("node")).join(out, "node", "left_anti")


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Topological level ``(node, level)``: length of the longest path from a free node.

    ``nodes`` (column ``node``) adds nodes without edges at level 0. Raises on a cycle.
    """
    settled, remaining = _settle(required(edges), scratch_path(edges.sparkSession, "levels"), "src", "dst")
    if not remaining.isEmpty():
        raise CyclicLineage("the requirements form a cycle")
    if nodes is not None:
        settled = settled.union(nodes.select("node", F.lit(0).cast("long")))
    return settled.groupBy("node").agg(F.max("level").alias("level"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that neither direction settles: those on a cycle or between two."""
    run = scratch_path(edges.sparkSession, "cycles")
    pairs = cut(required(edges), path=f"{run}/edges")
    _, behind = _settle(pairs, f"{run}/forward", "src", "dst")
    # What is not settled lies behind a cycle; the edges between such nodes are settled from their ends.
    inner = pairs.join(behind.withColumnRenamed("node", "src"), "src", "left_semi")
    _, core = _settle(inner, f"{run}/backward", "dst", "src")
    return core


def has_cycle(edges: DataFrame) -> bool:
    """Whether the requirements form a cycle."""
    _, remaining = _settle(required(edges), scratch_path(edges.sparkSession, "cycle"), "src", "dst")
    return not remaining.isEmpty()


def downstream(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node)`` affected by a change of the seeds: themselves and everything that requires them.

    ``seeds`` has a column ``node`` and optionally ``dependency``: a change of a step's
    dependency affects ``node.dependency`` and the step. Unknown seeds give nothing; nodes
    are known from the edges, or from ``nodes``. Works on cyclic graphs as well.

    What is near is followed edge by edge, from the frontier's buckets alone. What lies deeper is reached over
    paths of doubled length, so the number of rounds is logarithmic in the depth; see :func:`_reach_far`.
    """
    spark = edges.sparkSession
    run = scratch_path(spark, "downstream")
    pairs, size = cut_counted(required(edges).select(F.col("src").alias("front"), F.col("dst").alias("back")), f"{run}/edges")
    if nodes is None:
        known = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    else:
        known = nodes.select("node")
    starts, scoped = seeds.select("node"), None
    if "dependency" in seeds.columns:
        uses = edges.where(F.col("kind") == DEPENDS).select(F.col("src").alias("node"), F.col("dst").alias("dependency"))
        named = seeds.where(F.col("dependency").isNotNull()).join(uses, ["node", "dependency"], "left_semi")
        scoped = named.select(F.concat_ws(".", "node", "dependency").alias("node")).distinct()
        starts = seeds.where(F.col("dependency").isNull()).select("node").union(named.select("node"))
    seen = _Seen(spark, run, pairs.schema["front"].dataType)
    layout = _Layout(pairs, size["n"], f"{run}/layout")
    at = layout.bucket_set(F.col("node"))
    frontier, found = seen.add(known.join(starts.distinct(), "node", "left_semi").distinct(), buckets=at)
    while found["n"] and seen.rounds <= NEAR_ROUNDS:
        frontier, found = seen.step(layout.of(found["buckets"]), frontier, buckets=at)
    if found["n"]:
        _reach_far(pairs, size["n"], frontier, seen, run)
    reached = seen.table()
    return reached if scoped is None else reached.union(scoped)


class _Seen:
    """Nodes reached so far, a folder for each round."""

    def __init__(self, spark, run: str, node_type: T.DataType):
        self.spark, self.path, self.rounds = spark, f"{run}/seen", 0
        self.schema = T.StructType([T.StructField("node", node_type)])

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select("node")

    def add(self, new: DataFrame, **observed: Column) -> tuple[DataFrame, dict]:
        table, found = cut_observed(new, f"{self.path}/round={self.rounds}", n=F.count(F.lit(1)), **observed)
        self.rounds += 1
        return table, found

    def step(self, paths: DataFrame, start: DataFrame, **observed: Column) -> tuple[DataFrame, dict]:
        """Follow paths ``(front, back)`` from ``start``; the nodes not seen before."""
        ends = paths.join(start.select(F.col("node").alias("front")), "front").select(F.col("back").alias("node")).distinct()
        return self.add(ends.join(self.table(), "node", "left_anti"), **observed)


def _ways_on(paths: DataFrame, front: str, back: str) -> int:
    """Rows that paths joined to themselves, one's end to the other's start, would give."""
    ends = paths.groupBy(F.col(back).alias("node")).agg(F.count(F.lit(1)).alias("ins"))
    starts = paths.groupBy(F.col(front).alias("node")).agg(F.count(F.lit(1)).alias("outs"))
    return ends.join(starts, "node").agg(F.sum(F.col("ins") * F.col("outs")).alias("n")).first()["n"] or 0


def _reach_far(pairs: DataFrame, n_edges: int, frontier: DataFrame, seen: _Seen, run: str) -> None:
    """Complete ``seen``, which holds all nodes within some steps, over paths of 2, 4, 8 ... edges.

    Where all nodes within r steps are seen and r is at least 2^k - 1, following the paths of 2^k edges from all of them adds those
    within r + 2^k steps; when that adds none, none is left. Paths are joined to themselves for as long as they
    stay within ``PATH_GROWTH`` times the edges, which trees, chains and the like always do. In a graph where
    they would not, the longest made so far are followed from each round's new nodes.
    """
    k, paths = 0, pairs
    while True:
        if _ways_on(paths, "front", "back") > PATH_GROWTH * n_edges:
            break
        k += 1
        first = paths.select("front", F.col("back").alias("middle"))
        paths = cut(first.join(paths.select(F.col("front").alias("middle"), "back"), "middle").select("front", "back").distinct(), path=f"{run}/paths-{1 << k}")
        frontier, found = seen.step(paths, seen.table())
        if not found["n"]:
            return
    found = {"n": 1}
    while found["n"]:
        frontier, found = seen.step(paths, frontier)


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(step, missing, kind)``: requirements and dependencies that name an unknown step.

    A requirement is named by ``src``, a dependency by ``dst``.
    """
    kind = F.col("kind") if "kind" in edges.columns else F.lit(REQUIRES)
    named = edges.select(
        F.when(kind == DEPENDS, F.col("src")).otherwise(F.col("dst")).alias("step"),
        F.when(kind == DEPENDS, F.col("dst")).otherwise(F.col("src")).alias("missing"),
        kind.alias("kind"),
    )
    known = nodes.select(F.col("node").alias("missing")).distinct()
    return named.join(known, "missing", "left_anti").select("step", "missing", "kind")


def mixed_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dependencies between a row step and a set step, which are not allowed.

    ``nodes`` is ``(node, kind)`` with one row per node; returns
    ``(step, step_kind, dependency, dependency_kind)``.
    """
    uses = edges.where(F.col("kind") == DEPENDS) if "kind" in edges.columns else edges
    kinds = nodes.select("node", F.col("kind").alias("node_kind"))
    owners = kinds.select(F.col("node").alias("src"), F.col("node_kind").alias("step_kind"))
    targets = kinds.select(F.col("node").alias("dst"), F.col("node_kind").alias("dependency_kind"))
    return (
        uses.select("src", "dst").join(owners, "src").join(targets, "dst")
        .where(F.col("step_kind") != F.col("dependency_kind"))
        .select(F.col("src").alias("step"), "step_kind", F.col("dst").alias("dependency"), "dependency_kind")
    )


def _mark_shortcuts(pairs: DataFrame, n_edges: int, run: str) -> tuple[DataFrame, int]:
    """Edges ``(src, dst, shortcut)``, and how many are no shortcut: an edge beside which a way of two edges leads.

    In a graph without cycles the longest way between two nodes takes no shortcut, so without them the same nodes are reached
    over the same depths; with cycles that does not hold. Nothing is marked where the ways of two edges far outnumber the edges.
    """
    if _ways_on(pairs, "src", "dst") > PATH_GROWTH * n_edges:
        return pairs.withColumn("shortcut", F.lit(False)), n_edges
    first, second = pairs.select("src", F.col("dst").alias("middle")), pairs.select(F.col("src").alias("middle"), "dst")
    around = first.join(second, "middle").select("src", "dst", F.lit(False).alias("edge"))
    both = pairs.withColumn("edge", F.lit(True)).union(around).groupBy("src", "dst").agg(F.max("edge").alias("edge"), F.min("edge").alias("alone"))
    marked = both.where("edge").select("src", "dst", (~F.col("alone")).alias("shortcut"))
    marked, size = cut_counted(marked, f"{run}/marked", kept=F.count_if(~F.col("shortcut")))
    return marked, size["kept"]


def dependency_chain(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``(step, dependency, depth)``: all transitive dependencies, the deepest run first.

    ``seeds`` (column ``node``) names the steps wanted: the work is then bounded by what they depend on.
    Without it every step is followed, and a deep graph gives up to a row for each pair of nodes. Edges run
    from the owner (``src``) to its dependency (``dst``). Depth is the longest way from the step to the dependency. Raises on a cycle.

    Dependencies are taken in their topological order, one level at a time: all that leads to them is settled then, so a pair is
    written once, with its final depth. A level reads only the pairs that end where its edges begin. Edges that a way of
    two edges makes needless are not followed, see :func:`_mark_shortcuts`, and where every step is left with one dependency, no pair
    has two ways and nothing is shuffled to fold them.
    """
    spark = edges.sparkSession
    if "kind" in edges.columns:
        edges = edges.where(F.col("kind") == DEPENDS)
    run = scratch_path(spark, "chain")
    pairs = edges.select("src", "dst").distinct()
    if seeds is not None:
        wanted = cut(downstream(pairs, seeds.select("node")), path=f"{run}/wanted")
        pairs = pairs.join(wanted.withColumnRenamed("node", "src"), "src", "left_semi")
    pairs, size = cut_counted(pairs, f"{run}/edges")
    marked, kept = _mark_shortcuts(pairs, size["n"], run)
    followed = marked.where(~F.col("shortcut")).select("src", "dst")
    level, _ = _settle(followed, f"{run}/levels", "src", "dst", kept)
    placed = marked.join(level.select(F.col("node").alias("src"), F.col("level").alias("from_level")), "src", "left").join(
        level.select(F.col("node").alias("dst"), "level"), "dst", "left")
    # Levels that rise along every edge, shortcuts as well, are the proof that there is no cycle.
    seen = Observation()
    rises = F.coalesce(F.col("from_level") < F.col("level"), F.lit(False))
    placed = placed.observe(seen, F.count_if(~rises).alias("n")).where(~F.col("shortcut"))
    placed.select("src", "dst", "from_level", "level").write.partitionBy("level").parquet(f"{run}/by-level")
    if seen.get["n"]:
        raise CyclicLineage("the dependencies form a cycle")
    placed = spark.read.schema(T.StructType([*pairs.schema.fields]).add("from_level", "long").add("level", "long")).parquet(f"{run}/by-level")
    one_way = followed.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    found_schema = T.StructType().add("step", pairs.schema["src"].dataType).add("dependency", pairs.schema["dst"].dataType).add("depth", "long")
    # Levels and the levels that their edges come from: small numbers, a few for each level.
    froms: dict[int, list[int]] = {}
    for row in placed.select("level", "from_level").distinct().collect():
        froms.setdefault(row["level"], []).append(row["from_level"])
    for now in sorted(froms):
        # Read by folder: filtered by level, a table would count with its whole size when Spark picks the join.
        here = spark.read.schema(pairs.schema).parquet(f"{run}/by-level/level={now}")
        direct = here
        if seeds is not None:
            direct = here.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        ways = direct.select(F.col("src").alias("step"), F.col("dst").alias("dependency"), F.lit(1).cast("long").alias("depth"))
        before = [x for x in froms[now] if x in froms]
        if before:
            done = spark.read.schema(found_schema).parquet(*[f"{run}/pairs/level={x}" for x in before])
            done = done.select("step", F.col("dependency").alias("src"), "depth")
            longer = done.join(here, "src").select("step", F.col("dst").alias("dependency"), (F.col("depth") + 1).alias("depth"))
            ways = ways.union(longer)
        if not one_way:
            ways = ways.groupBy("step", "dependency").agg(F.max("depth").alias("depth"))
        cut_counted(ways, f"{run}/pairs/level={now}", row_group=PAIR_ROW_GROUP)
    if not froms:
        return spark.createDataFrame([], found_schema)
    return spark.read.schema(found_schema).parquet(f"{run}/pairs").select("step", "dependency", "depth")
