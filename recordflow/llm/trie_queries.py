"""Query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm.prefix_trie import end_digests, numbered_turns, prefix_trie
from recordflow.llm.registry import query, table
from recordflow.storage import cut

# Conversations that share first turns, by hundreds of ids; the checksum says how many turns.
GROUP, MOST = 100, 6

_TRIE_SQL = """
WITH e AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda v, b:
    list_reduce(list_prepend(xor(v, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)),
    4294967295::BIGINT) % 6 AS h FROM e
), t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    md5(coalesce(role, '')) || md5(coalesce(text, '')) AS s, length(coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), z AS (
  SELECT c, count(*) AS n FROM t GROUP BY c
), r AS (
  SELECT h.c, t.i AS d, s, w FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i <= h.h
  UNION ALL
  SELECT h.c, least(h.h, coalesce(z.n, 0)) + t.i - h.h, s, w FROM h JOIN t ON t.c = h.c AND t.i > h.h LEFT JOIN z ON z.c = h.c - h.c % 100
), l AS (
  SELECT e.c, coalesce(list(s ORDER BY d) FILTER (d IS NOT NULL), []) AS ss, coalesce(list(w ORDER BY d) FILTER (d IS NOT NULL), []) AS ws
  FROM e LEFT JOIN r ON r.c = e.c GROUP BY e.c
), p AS (
  SELECT c, ss, ws, unnest(range(0, len(ss) + 1)) AS d FROM l
), q AS (
  SELECT c, d, md5(array_to_string(ss[1:d], ',')) AS k, md5(array_to_string(ss[1:d - 1], ',')) AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ss) AS ends FROM p
), n AS (
  SELECT d, k, any_value(up) AS up, min(c) AS conv, count(*) AS m, any_value(w) AS w, string_agg(c, ',' ORDER BY c) FILTER (ends) AS es FROM q GROUP BY d, k
), b AS (
  SELECT d - 1 AS d, up AS k, count(*) AS children FROM n WHERE d > 0 GROUP BY 1, 2
), x AS (
  SELECT n.*, coalesce(b.children, 0) AS children FROM n LEFT JOIN b ON b.d = n.d AND b.k = n.k
), a AS (
  SELECT q.d, q.k, sum((x.children = 0)::INT) AS leaves, sum((x.m - 1) * x.w) AS saved FROM x JOIN q ON q.c = x.conv AND q.d <= x.d GROUP BY 1, 2
)
SELECT x.conv AS conv_id, x.d::BIGINT AS depth, o.conv AS parent_conv_id, x.m::BIGINT AS n_convs, x.children::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves,
  a.saved::BIGINT AS saved_tokens, sha256(coalesce(x.es, '')) AS ends_sha256
FROM x JOIN a ON a.d = x.d AND a.k = x.k LEFT JOIN n o ON o.d = x.d - 1 AND o.k = x.up
"""


def with_shared_starts(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and conversations, where each begins with the first turns of its group's first conversation."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST).cast("int")
    plan = convs.select("conv_id", "n", h.alias("h"), base.alias("base"))
    sizes = convs.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    borrowed = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = cut(plan.join(sizes, "base", "left").select("conv_id", "base", "h", "n", borrowed.alias("borrowed")), "shared-starts")
    own = turns.join(plan.select("conv_id", "h", "borrowed"), "conv_id").where(F.col("depth") > F.col("h"))
    own = own.withColumn("depth", F.col("depth") - F.col("h") + F.col("borrowed"))
    first = turns.where((base == F.col("conv_id")) & (F.col("depth") < MOST)).withColumnRenamed("conv_id", "base")
    starts = first.join(plan.where("borrowed > 0").select("conv_id", "base", "borrowed"), "base").where(F.col("depth") <= F.col("borrowed"))
    columns = ["conv_id", "depth", "t1", "t2", "weight"]
    made = cut(own.select(*columns).unionByName(starts.select(*columns)), "rebuilt")
    return made, plan.select("conv_id", (F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


@query("op13_prefix_trie", _TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie(*with_shared_starts(*numbered_turns(table(spark, sf_dir, "conversations"))))
    digests = end_digests(ends)
    depth = F.col("depth").cast("long").alias("depth")
    found = nodes.join(digests, ["depth", "conv_id"], "left")
    return found.select(
        "conv_id", depth, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
