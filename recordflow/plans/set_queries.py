"""Set steps and settings lookup over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators.lookup import layered_lookup
from recordflow.operators.records import KEY, keyed_records
from recordflow.operators.sets import (
    attach,
    concat_content,
    every_nth,
    gather,
    keep_ids,
    pass_through,
    remap,
    set_chain,
    set_manifest,
    set_step,
    set_value,
    take_while,
    with_set_result,
)
from recordflow.operators.steps import map_step
from recordflow.plans.registry import cents, query, table


def _orders(spark, sf_dir):
    labels = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "price": cents("o_totalprice")}
    return keyed_records(table(spark, sf_dir, "orders"), "o_orderkey", labels)


@query(
    "set_step",
    """SELECT count(*) AS n_records, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total,
      min(o_orderstatus) AS first_status, CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS largest FROM orders""",
)
def totals(spark, sf_dir):
    return set_step(
        _orders(spark, sf_dir),
        {"n_records": F.count(F.lit(1)), "total": F.sum("price"), "first_status": F.min("status"), "largest": F.max("price")},
    )


@query(
    "broadcast_set_result",
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
    s AS (SELECT count(*) AS n, sum(price) AS total FROM o)
    SELECT record_id, CAST(price - total // n AS BIGINT) AS deviation, n AS n_records FROM o, s""",
)
def deviation(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    mean = set_step(orders, {"n": F.count(F.lit(1)), "total": F.sum("price")})
    return with_set_result(orders, "Mean", mean).select(
        KEY, (F.col("price") - F.expr("Mean.total div Mean.n")).alias("deviation"), F.col("Mean.n").alias("n_records")
    )


@query(
    "set_chain",
    """WITH o AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
    s AS (SELECT count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM o),
    above AS (SELECT count(*) AS n_above, CAST(max(price) AS BIGINT) AS largest FROM o, s WHERE price * n > total)
    SELECT n, total, n_above, (SELECT count(*) FROM o WHERE price * 2 > (SELECT largest FROM above)) AS n_top FROM s, above""",
)
def chained_sets(spark, sf_dir):
    def mean(records):
        return set_step(records, {"n": F.count(F.lit(1)), "total": F.sum("price")})

    def above(records):
        high = records.where(F.col("price") * F.col("Mean.n") > F.col("Mean.total"))
        return set_step(high, {"n_above": F.count(F.lit(1)), "largest": F.max("price")})

    def top(records):
        return set_step(records.where(F.col("price") * 2 > F.col("Above.largest")), {"n_top": F.count(F.lit(1))})

    done = set_chain(_orders(spark, sf_dir), [("Mean", mean), ("Above", above), ("Top", top)])
    return done.select("Mean.n", "Mean.total", "Above.n_above", "Top.n_top")


@query(
    "pass_through",
    """WITH s AS (SELECT count(*) AS n FROM customer)
    SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_mktsegment AS segment, n AS set_size FROM customer, s""",
)
def passed(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_custkey", {"segment": F.col("c_mktsegment")})
    size = set_step(customers, {"n": F.count(F.lit(1))})
    return pass_through(customers).select(KEY, "segment", set_value(size)["n"].alias("set_size"))


@query(
    "attach_update",
    """WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, lang FROM documents),
    o AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(quality AS BIGINT) AS quality FROM labels
          UNION ALL SELECT concat('item', item_id), CAST(-1 AS BIGINT) FROM benchmark)
    SELECT o.record_id, r.lang, o.quality FROM o LEFT JOIN r ON o.record_id = r.record_id""",
)
def attached(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["lang"])
    known = keyed_records(table(spark, sf_dir, "labels"), "doc_id", {"quality": F.col("quality").cast("long")})
    new_id = F.concat(F.lit("item"), "item_id")
    new = keyed_records(table(spark, sf_dir, "benchmark"), new_id, {"quality": F.lit(-1).cast("long")})
    return attach(documents, "Quality", known.union(new)).select(KEY, "lang", "Quality.quality")


@query(
    "keep_ids",
    """SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_mktsegment AS segment FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)""",
)
def kept_ids(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_custkey", {"segment": F.col("c_mktsegment")})
    large = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 400000")
    return keep_ids(customers, keyed_records(large, "o_custkey", []))


@query(
    "gather",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, md5(text) AS digest FROM documents WHERE lang = 'fr'""",
)
def gathered(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang"])
    stepped = map_step(documents, "Digest", run={"digest": F.md5("text")}, condition=F.col("lang") == "fr")
    return gather(stepped, "Digest", "digest", only_ran=True)


@query(
    "concat_content",
    r"""SELECT concat(doc_id, ':', i - 1) AS content_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(i - 1 AS BIGINT) AS item_no, md5(lines[i]) AS digest
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""",
)
def concatenated(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    lines = concat_content(documents, F.split("text", "\n", -1))
    return lines.select("content_id", KEY, "item_no", F.md5("item").alias("digest"))


@query(
    "set_manifest",
    "SELECT concat(c_custkey, chr(9), c_name) AS value FROM customer",
)
def manifest(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_custkey", ["c_name"])
    return set_manifest(customers, F.col("c_name"))


@query(
    "remap_explode",
    """SELECT concat(conv_id, '.', turn, '.', i) AS record_id, CAST(length(string_split(text, '. ')[i]) AS BIGINT) AS n
    FROM (SELECT conv_id, turn, text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM conversations)""",
)
def remapped(spark, sf_dir):
    turn_id = F.concat_ws(".", "conv_id", "turn")
    turns = keyed_records(table(spark, sf_dir, "conversations"), turn_id, ["text"])

    def sentences(records):
        parts = records.select(KEY, F.posexplode(F.split("text", r"\. ", -1)).alias("i", "sentence"))
        new_id = F.concat_ws(".", KEY, (F.col("i") + 1).cast("string"))
        return keyed_records(parts, new_id, {"n": F.length("sentence").cast("long")})

    return remap(turns, sentences)


@query(
    "remap_group",
    """SELECT CAST(user_id AS VARCHAR) AS record_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types,
      CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""",
)
def regrouped(spark, sf_dir):
    labels = {"user": F.col("user_id"), "kind": F.col("event_type"), "amount": cents("value")}
    events = keyed_records(table(spark, sf_dir, "events"), "event_id", labels)

    def users(records):
        # Folded to one row per user and kind first, so that a busy user is summed where its rows are.
        kinds = records.groupBy("user", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        by_user = kinds.groupBy(F.col("user").cast("string").alias(KEY))
        return by_user.agg(
            F.sum("n").alias("n_events"), F.count("kind").alias("n_types"), F.sum("amount").alias("total")
        )

    return remap(events, users)


@query(
    "take_while",
    """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders
    WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice >= 2000), 9223372036854775807)""",
)
def leading(spark, sf_dir):
    leading_orders = take_while(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") >= 2000)
    return keyed_records(leading_orders, "o_orderkey", {"price": cents("o_totalprice")})


@query(
    "every_nth",
    """SELECT record_id, segment FROM (
      SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_mktsegment AS segment, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS i
      FROM customer) WHERE i % 2 = 0""",
)
def second(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_custkey", {"segment": F.col("c_mktsegment")})
    return every_nth(customers, 2, offset=1)


@query(
    "every_nth_ordered",
    """SELECT record_id, price FROM (
      SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(round(o_totalprice * 100) AS BIGINT) AS price,
        row_number() OVER (ORDER BY o_orderstatus, CAST(o_orderkey AS VARCHAR)) AS i FROM orders) WHERE i % 7 = 1""",
)
def seventh(spark, sf_dir):
    return every_nth(_orders(spark, sf_dir), 7, order=["status"]).select(KEY, "price")


@query(
    "layered_lookup",
    """WITH own AS (SELECT source, CAST(max(n_chars) // 2 AS BIGINT) AS threshold FROM documents GROUP BY 1 HAVING count(*) > 10),
    fallback AS (SELECT lang, CAST(min(n_chars) AS BIGINT) AS threshold FROM documents WHERE lang <> 'es' GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS record_id, d.source, d.lang, coalesce(own.threshold, fallback.threshold) AS threshold
    FROM documents d LEFT JOIN own ON d.source = own.source LEFT JOIN fallback ON d.lang = fallback.lang""",
)
def looked_up(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    own = documents.groupBy("source").agg(F.expr("max(n_chars) div 2").alias("threshold"), F.count(F.lit(1)).alias("n"))
    fallback = documents.where("lang <> 'es'").groupBy("lang").agg(F.min("n_chars").alias("threshold"))
    records = keyed_records(documents, "doc_id", ["source", "lang"])
    return layered_lookup(records, own.where("n > 10"), "source", fallback, "lang", "threshold")
