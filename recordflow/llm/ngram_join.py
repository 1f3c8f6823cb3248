"""Jaccard join of documents on word n-grams, and the classes its links make.

A document's set holds the 64-bit hashes of its distinct shingles of ``SHINGLE`` words (its whole
word sequence if that is shorter). Documents with one set are one *node*; a node's key is a hash
of the set. Two nodes link when ``100 * intersection >= percent * union``.

1. One pass over the texts gives every document its node, and counts shingles in a count-min
   sketch over all documents. The sketch has a fixed size, whatever the table's.
2. Shingles are ordered by that count, rare first, ties by hash. Nodes that link share one of
   their first ``n - ceil(percent * n / 100) + 1`` shingles in this order, the *prefix*.
3. A prefix shingle's nodes are its *bucket*. The smallest node leads; all others are compared with
   it and not with one another. Length and positional filters first, then one exact verification for each
   pair, whichever buckets it is in. (The suffix filter would move more for these pairs than it saves.)
4. Two nodes that meet in a bucket both meet its leader. So what is left to compare are nodes apart from
   their leader, each with the other nodes of that leader. First with a few of them, chosen by
   hash, for some rounds: this joins most near copies to their class. Then with all the rest that is
   of another class and not ruled out, by length, by the triangle inequality of the Jaccard distance to the
   leader, or by the suffix filter, which compares how many shingles both have in each range of the hash. No
   link is lost: each pair that meets is verified, connected already, or shown to be too far apart.

So a group of thousands of near copies costs a few comparisons each, not one for each pair. Buckets
that the sketch proves small are walked by a sorted stream; frequent shingles, whose bucket may
be of any size, go through aggregates and joins that Spark splits.

NULL texts and texts without words have the empty set and link with nothing; so do documents with
a NULL id when no other has their set. Repeated rows are one node. A document that repeats an id with
another text is a document of its own. An empty table gives an empty result. Hashes of 64 bits stand
for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm import textbytes as tb
from recordflow.llm.components import components
from recordflow.llm.tables import bound_batches
from recordflow.storage import broadcast_if_small, cut

SHINGLE = 5
PERCENT = 80

SKETCH_BITS = 18
SKETCH_PART = 4096
# Buckets up to this many nodes, or up to some times the mean counter, are walked in one stream.
STREAM_ROWS = 2_000
STREAM_TIMES_MEAN = 4
RANGES = 128
# Nodes of each leader that those apart from it are compared with in a round; rounds end once they help little.
PROBES = 4
PROBE_SHRINK = 0.7

_SKETCH = 1 << SKETCH_BITS


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, letters A-Z lowered."""
    for chunk in tb.chunks(texts):
        found = tb.words(chunk)
        hashes = tb.word_hashes(chunk, found, lower=True)
        n_words = tb.counts(found.text, chunk.size)
        edges = np.concatenate([[0], np.cumsum(n_words)])
        value, at = tb.windows(hashes, found.text, width)
        text = found.text[at]
        limits = np.searchsorted(text, np.arange(chunk.size + 1))
        for i in range(chunk.size):
            if n_words[i] >= width:
                yield np.unique(value[limits[i] : limits[i + 1]])
            elif n_words[i]:
                short = hashes[edges[i] : edges[i + 1]]
                whole = tb.windows(short, np.zeros(len(short), int), len(short))[0]
                yield tb.mix(whole + np.uint64(len(short)))
            else:
                yield np.zeros(0, np.uint64)


def _set_key(shingles: np.ndarray) -> int:
    """Hash of a set; NULL-like 0 never stands for a set with shingles."""
    total = np.add.reduce(tb.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    return int(tb.mix(np.array([total + np.uint64(len(shingles))]))[0].astype(np.int64))


def _counters(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sketch counters of each shingle."""
    mask = np.uint64(_SKETCH - 1)
    first = (shingles & mask).astype(np.int64)
    return first, ((shingles >> np.uint64(32)) & mask).astype(np.int64) + _SKETCH


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(2 * _SKETCH, dtype=np.int64)
    names = ["doc_id", "n", "node", "part", "counts"]
    id_type = None
    for batch in batches:
        keys, sizes, n, id_type = [], [], batch.num_rows, batch.column(0).type
        for s in shingle_sets(batch.column(1)):
            for counter in _counters(s):
                np.add.at(sketch, counter, 1)
            keys.append(_set_key(s) if len(s) else 0)
            sizes.append(len(s))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(n, pa.int32()),
             pa.nulls(n, pa.list_(pa.int64()))], names=names)
    if id_type is None:
        return
    parts = [k for k in range(2 * _SKETCH // SKETCH_PART) if sketch[k * SKETCH_PART : (k + 1) * SKETCH_PART].any()]
    n, none = len(parts), pa.nulls(len(parts), pa.int64())
    rows = [sketch[k * SKETCH_PART : (k + 1) * SKETCH_PART] for k in parts]
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(n, id_type), none, none, pa.array(parts, pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=names)


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = counts.values.to_numpy()
            total[part] = total[part] + values if part in total else values.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["part", "counts"])


def _prefixes(shingles: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix shingles and their counts, rare first."""
    first, second = _counters(shingles)
    rarity = np.minimum(counts[first], counts[second])
    n = len(shingles)
    size = n - (percent * n + 99) // 100 + 1
    order = np.lexsort((shingles, rarity))[:size]
    return shingles[order], rarity[order]


def range_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles of a sorted set in each of ``RANGES`` equal ranges of the hash."""
    edges = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)
    cuts = np.concatenate([[0], np.searchsorted(shingles, edges), [len(shingles)]])
    return np.diff(cuts).astype(np.int32)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _stream_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a bucket beside the bucket's first; rows come sorted by shingle, size and node."""
    names = ["token", "node", "n", "pos", "leader", "ln", "lpos"]
    last: tuple[int, int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, node, n, pos = (batch.column(k).to_numpy() for k in range(4))
        head = np.ones(len(token), dtype=bool)
        head[1:] = token[1:] != token[:-1]
        if last is not None and last[0] == token[0]:
            head[0] = False
        first = np.maximum.accumulate(np.where(head, np.arange(len(token)), -1))
        at = np.flatnonzero(~head)
        from_last = first[at] < 0
        lead = [np.where(from_last, last[k] if last else 0, c[first[at]]) for k, c in ((1, node), (2, n), (3, pos))]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token[at], node[at], n[at], pos[at], *lead)], names=names)
        if first[-1] >= 0:
            k = first[-1]
            last = (int(token[k]), int(node[k]), int(n[k]), int(pos[k]))


_STAR = "token long, node long, n int, pos int, leader long, ln int, lpos int"


class NgramJoin:
    """One run over ``docs(doc_id, text)``; every table it keeps is in the shared folder."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE):
        if width != SHINGLE:
            raise ValueError(f"shingles have {SHINGLE} words")
        self.spark, self.percent = docs.sparkSession, percent
        bound_batches(self.spark)
        self.docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs_of_nodes, self.classes = self._run()

    def _run(self) -> tuple[DataFrame, DataFrame]:
        id_type = self.docs.schema["doc_id"].dataType.simpleString()
        profile = cut(self.docs.mapInArrow(_profile, f"doc_id {id_type}, n long, node long, part int, counts array<long>"), "profile")
        docs = profile.where(F.col("part").isNull()).select("doc_id", "n", "node")
        sums = profile.where(F.col("part").isNotNull()).select("part", "counts").repartition("part")
        counts = np.zeros(2 * _SKETCH, dtype=np.int64)
        # A row for each of the sketch's fixed parts.
        for row in sums.mapInArrow(_add_parts, "part int, counts array<long>").collect():
            counts[row["part"] * SKETCH_PART : (row["part"] + 1) * SKETCH_PART] += row["counts"]
        self.sets = docs.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"))
        self.sets = cut(self.sets.where(F.col("first_id").isNotNull()), "sets")
        nodes = self._nodes(counts)
        return docs, self._links(nodes)

    def _nodes(self, counts: np.ndarray) -> DataFrame:
        """``(node, n, tokens, n_light, ranges)``: prefix, how many of it are proven rare, counts by hash range."""
        percent = self.percent
        shared = self.spark.sparkContext.broadcast(counts)
        self.stream_rows = max(STREAM_ROWS, int(STREAM_TIMES_MEAN * counts.mean()))
        most = self.stream_rows
        id_type = self.docs.schema["doc_id"].dataType.simpleString()

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, tokens, light, ranges = [], [], [], []
                for s in shingle_sets(batch.column(1)):
                    if not len(s):
                        keys.append(0), tokens.append(None), light.append(None), ranges.append(None)
                        continue
                    prefix, rarity = _prefixes(s, shared.value, percent)
                    keys.append(_set_key(s))
                    tokens.append(prefix.astype(np.int64))
                    light.append(int((rarity <= most).sum()))
                    ranges.append(range_counts(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(light, pa.int32()),
                     pa.array(ranges, pa.list_(pa.int32()))], names=["doc_id", "node", "tokens", "n_light", "ranges"])

        made = self.docs.mapInArrow(prefixes, f"doc_id {id_type}, node long, tokens array<long>, n_light int, ranges array<int>")
        made = made.where(F.col("tokens").isNotNull())
        one_each = self.sets.select("node", F.col("first_id").alias("doc_id"), F.col("n").cast("int").alias("n"))
        joined = made.join(one_each, ["node", "doc_id"]).dropDuplicates(["node", "doc_id"])
        return cut(joined.select("node", "n", "tokens", "n_light", "ranges"), "nodes")

    def _star_pairs(self, nodes: DataFrame) -> DataFrame:
        """``(leader, node, ln, n, most)``: every node with the leaders of its buckets, once for each."""
        rows = nodes.select("node", "n", "n_light", F.posexplode("tokens").alias("pos", "token"))
        light = rows.where(F.col("pos") < F.col("n_light")).select("token", "node", "n", "pos")
        light = light.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(_stream_stars, _STAR)
        heavy = rows.where(F.col("pos") >= F.col("n_light")).select("token", "node", "n", "pos")
        stars = light.union(self._joined_stars(heavy))
        before = F.least("pos", "lpos")
        after = F.least(F.col("n") - F.col("pos"), F.col("ln") - F.col("lpos")) - 1
        stars = stars.withColumn("most", (before + 1 + after).cast("long"))
        return cut(stars.groupBy("leader", "node", "ln", "n").agg(F.min("most").alias("most")), "star-pairs")

    @staticmethod
    def _joined_stars(rows: DataFrame) -> DataFrame:
        lead = rows.groupBy("token").agg(F.min(F.struct("n", "node", "pos")).alias("l"), F.count(F.lit(1)).alias("__m"))
        lead = lead.where(F.col("__m") > 1).select(
            "token", F.col("l.node").alias("leader"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"))
        joined = rows.join(lead, "token").where(F.col("node") != F.col("leader"))
        return joined.select("token", "node", "n", "pos", "leader", "ln", "lpos")

    def _links(self, nodes: DataFrame) -> DataFrame:
        """Classes of nodes ``(u, v)`` after all links; see the module text."""
        met = self._star_pairs(nodes)
        self.texts = self._texts(met)
        need = F.ceil(F.lit(self.percent) * (F.col("ln") + F.col("n")) / F.lit(100 + self.percent))
        opened = self._verify(met.where(F.col("most") >= need).select(F.col("leader").alias("x"), F.col("node").alias("y"), "ln", "n"))
        closed = met.where(F.col("most") < need).select(F.col("leader").alias("x"), F.col("node").alias("y"), "ln", "n", F.lit(None).cast("long").alias("same"), "most")
        stars = cut(opened.withColumn("most", F.col("same")).unionByName(closed), "stars")
        judged = [stars.select("x", "y")]
        classes = components(self._linked(stars).select(F.col("x").alias("u"), F.col("y").alias("v")))
        apart = self._apart(stars, nodes, classes)
        last, turn = None, 0
        while True:
            left = apart.where(F.col("lc") != F.col("nc"))
            n_left = left.select("node").distinct().count()
            if not n_left:
                return classes
            done = last is not None and n_left > PROBE_SHRINK * last
            verified = self._judge(self._rest(left, apart) if done else self._probes(left, apart, turn), judged)
            if verified is not None:
                classes = self._merged(classes, self._linked(verified).select(F.col("xc").alias("u"), F.col("yc").alias("v")).distinct())
            if done:
                return classes
            apart = self._marked(apart.drop("lc", "nc"), classes)
            last, turn = n_left, turn + 1

    def _linked(self, verified: DataFrame) -> DataFrame:
        linked = 100 * F.col("same") >= self.percent * (F.col("ln") + F.col("n") - F.col("same"))
        return verified.where(F.col("same").isNotNull() & linked)

    @staticmethod
    def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
        """``classes`` after ``links(u, v)`` between classes; only these are searched for components."""
        moved = cut(components(links), "moved")
        if moved.isEmpty():
            return classes
        joined = classes.join(moved.toDF("v", "__to"), "v", "left").select("u", F.coalesce("__to", "v").alias("v"))
        return cut(joined.unionByName(moved), "merged")

    def _marked(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """``pairs`` with the class of leader and node."""
        of = lambda name, out: classes.select(F.col("u").alias(name), F.col("v").alias(out))
        marked = pairs.join(of("leader", "lc"), "leader", "left").join(of("node", "nc"), "node", "left")
        return cut(marked.withColumns({"lc": F.coalesce("lc", "leader"), "nc": F.coalesce("nc", "node")}), "marked")

    def _apart(self, stars: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs with a leader that a node of another class is apart from: bounds of their distance, and ranges."""
        far = lambda same: 1 - same / (F.col("ln") + F.col("n") - same)
        pairs = stars.select(F.col("x").alias("leader"), F.col("y").alias("node"), "n", far(F.col("most")).alias("low"),
                             F.coalesce(far(F.col("same")), F.lit(1.0)).alias("high"))
        marked = self._marked(pairs, classes)
        leaders = marked.where(F.col("lc") != F.col("nc")).select("leader").distinct()
        return cut(marked.join(leaders, "leader", "left_semi").join(nodes.select("node", "ranges"), "node"), "apart")

    def _near(self, other: str) -> Column:
        """Whether a node apart and another one of its leader, with fields of the struct ``other``, may link."""
        reach = 1 - self.percent / 100 + 1e-9
        o = F.col(other)
        short, long = F.least(F.col("n"), o["n"]), F.greatest(F.col("n"), o["n"])
        return ((F.col("node") != o["node"]) & (F.col("nc") != o["nc"]) & (100 * short >= self.percent * long)
                & (F.col("low") - o["high"] <= reach) & (o["low"] - F.col("high") <= reach))

    @staticmethod
    def _pairs(joined: DataFrame, other: str) -> DataFrame:
        o = F.col(other)
        first = F.col("node") < o["node"]
        of = lambda name: [F.when(first, F.col(name)).otherwise(o[name]), F.when(first, o[name]).otherwise(F.col(name))]
        (ln, n), (xc, yc) = of("n"), of("nc")
        return joined.select(F.least("node", o["node"]).alias("x"), F.greatest("node", o["node"]).alias("y"),
                             ln.alias("ln"), n.alias("n"), xc.alias("xc"), yc.alias("yc"))

    def _probes(self, left: DataFrame, apart: DataFrame, turn: int) -> DataFrame:
        """Nodes apart beside a few others of their leader: some of its own class and some that are not."""
        entry = F.struct("node", "n", "low", "high", "nc")
        own = F.col("lc") == F.col("nc")
        picks = [F.min_by(entry, F.when(own if side else ~own, F.xxhash64("node", F.lit(turn * PROBES + k)))) for k in range(PROBES) for side in (True, False)]
        chosen = apart.groupBy("leader").agg(F.array_distinct(F.array_compact(F.array(*picks))).alias("__o"))
        joined = left.join(chosen, "leader").withColumn("o", F.explode("__o")).where(self._near("o"))
        return self._pairs(joined, "o")

    def _rest(self, left: DataFrame, apart: DataFrame) -> DataFrame:
        """Nodes apart beside all others of their leader that are of another class and not ruled out."""
        entry = F.struct("node", "n", "low", "high", "nc").alias("o")
        ranges = [F.col("ranges")[k] for k in range(RANGES)]
        mine = left.select("leader", "node", "n", "low", "high", "nc", *[r.alias(f"r{k}") for k, r in enumerate(ranges)])
        others = apart.select("leader", entry, (F.col("lc") == F.col("nc")).alias("own"), *[r.alias(f"s{k}") for k, r in enumerate(ranges)])
        # Leaders' own classes reach no farther than this towards the nearest node apart.
        nearest = left.groupBy("leader").agg(F.min("low").alias("least"))
        others = others.join(nearest, "leader").where(F.col("o.high") >= F.col("least") - (1 - self.percent / 100) - 1e-9)
        shared = sum((F.least(f"r{k}", f"s{k}") for k in range(1, RANGES)), F.least("r0", "s0"))
        enough = (100 + self.percent) * shared >= self.percent * (F.col("n") + F.col("o.n"))
        once = F.col("own") | (F.col("node") < F.col("o.node"))
        return self._pairs(mine.join(others, (mine["leader"] == others["leader"]) & once & self._near("o") & enough), "o")

    def _judge(self, pairs: DataFrame, judged: list[DataFrame]) -> DataFrame | None:
        """New pairs ``(x, y, ln, n, xc, yc)`` verified, and added to ``judged``; None if there are none."""
        known = _union(judged).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        pairs = cut(pairs.distinct().join(known, ["x", "y"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return None
        verified = cut(self._verify(pairs), "verified")
        judged.append(verified.select("x", "y"))
        return verified

    def _texts(self, met: DataFrame) -> DataFrame:
        """``(node, text)`` of all nodes that meet another one."""
        wanted = met.select("node").union(met.select(F.col("leader").alias("node"))).distinct()
        ids = wanted.join(self.sets, "node").select("node", F.col("first_id").alias("doc_id"))
        ids = broadcast_if_small(cut(ids, "wanted"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [(_set_key(s) if len(s) else 0) for s in shingle_sets(batch.column(1))]
                keep = pa.array(np.array(keys, dtype=np.int64) == batch.column(0).to_numpy())
                yield batch.filter(keep)

        texts = self.docs.join(ids, "doc_id").select("node", "text").mapInArrow(check, "node long, text string")
        # The same id twice with the same text is one node.
        return cut(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the exact intersection ``same``, from the whole texts of their nodes ``x`` and ``y``."""
        keep = pairs.columns

        def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = zip(shingle_sets(batch.column(len(keep))), shingle_sets(batch.column(len(keep) + 1)), strict=True)
                same = pa.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], same], names=[*keep, "same"])

        both = pairs.join(self.texts.withColumnsRenamed({"node": "x", "text": "xt"}), "x").join(
            self.texts.withColumnsRenamed({"node": "y", "text": "yt"}), "y")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
        return both.select(*keep, "xt", "yt").mapInArrow(intersect, f"{schema}, same long")

    def result(self) -> DataFrame:
        """``(doc_id, n_shingles, component_id)`` of every document, repeated rows included."""
        comp = self.sets.join(self.classes.withColumnRenamed("u", "node"), "node", "left").select(
            "node", "first_id", F.coalesce("v", "node").alias("comp"))
        least = comp.groupBy("comp").agg(F.min("first_id").alias("component_id"))
        ids = cut(comp.join(least, "comp").select("node", "component_id"), "node-components")
        joined = self.docs_of_nodes.join(ids, "node", "left")
        return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``; the least id reachable by links names the class."""
    return NgramJoin(docs, percent).result()


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each class stays, that with the least id.

    Rows that repeat an id are one document here: the first of them in text order stays. Documents
    without an id all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    classes = cut(near_duplicates(docs, percent).where(F.col("doc_id").isNotNull()), "classes")
    dropped = classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(cut(dropped, "dropped")), "doc_id", "left_anti").select(*columns)
    again = cut(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]).alias("r")
    first = kept.join(again, "doc_id", "left_semi").select("doc_id", others)
    first = first.groupBy("doc_id").agg(F.min_by("r", F.coalesce("r.text", F.lit(""))).alias("r"))
    once = first.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"r.`{c}`") for c in docs.columns])
    return kept.join(again, "doc_id", "left_anti").select(*columns).unionByName(once)
