"""Results store, lineage and incremental runs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators.lineage import (
    cyclic_nodes,
    dependency_chain,
    downstream,
    levels,
    mixed_kinds,
    unresolved,
)
from recordflow.operators.records import KEY, keyed_records
from recordflow.operators.steps import map_step
from recordflow.plans.registry import cents, query, table
from recordflow.sources.results import (
    export_results,
    export_steps,
    latest,
    load_results,
    purge_steps,
    read_results,
    remove_from_store,
    remove_ids,
    write_results,
)
from recordflow.sources.store import open_store
from recordflow.storage import scratch_path
from recordflow.streaming.incremental import run_incremental


@query(
    "export_results",
    """SELECT 'docs' AS pipeline, 'Measure' AS step, CAST(1 AS BIGINT) AS step_no, CAST(doc_id AS VARCHAR) AS record_id, l.label,
      CASE WHEN l.label = 'lang' THEN lang ELSE CAST(n_chars AS VARCHAR) END AS value
    FROM documents, (VALUES ('lang'), ('n_chars')) l(label) WHERE lang <> 'de'""",
)
def exported(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["lang", "n_chars"])
    stepped = map_step(
        documents, "Measure", run={"lang": F.col("lang"), "n_chars": F.col("n_chars")}, condition=F.col("lang") != "de"
    )
    results = export_results(stepped, "Measure", ["lang", "n_chars"], "docs", 1)
    return results.withColumn("step_no", F.col("step_no").cast("long"))


def _order_results(spark, sf_dir):
    """Exports of two runs over orders; the second step of ``intake`` replaces some labels."""
    labels = {"state": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "price": cents("o_totalprice")}
    orders = keyed_records(table(spark, sf_dir, "orders"), "o_orderkey", labels)
    read = {"status": F.col("state"), "priority": F.col("priority"), "price": F.col("price")}
    stepped = map_step(orders, "Read", run=read)
    grade = {"status": F.lit("large"), "grade": F.concat_ws("-", F.col("state"), F.lit("L"))}
    stepped = map_step(stepped, "Grade", run=grade, condition=F.col("price") > 20000000)
    stepped = map_step(stepped, "Bill", run={"status": F.lit("billed"), "amount": F.col("price") * 2}, condition=F.col("state") == "F")
    intake = export_steps(stepped, {"Read": list(read), "Grade": list(grade)}, "intake")
    return intake.union(export_steps(stepped, {"Bill": ["status", "amount"]}, "billing"))


def _order_store(spark, sf_dir):
    """The same exports, written to a store and read back."""
    path = scratch_path(spark, "results")
    write_results(_order_results(spark, sf_dir), path)
    return open_store(spark, path)


_ORDERS_CTE = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderstatus AS state, o_orderpriority AS priority,
  CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders)"""


@query(
    "load_results_all",
    _ORDERS_CTE + """ SELECT record_id, CASE WHEN price > 20000000 THEN concat(state, '-L') END AS grade, CAST(price AS VARCHAR) AS price, priority,
      CASE WHEN price > 20000000 THEN 'large' ELSE state END AS status FROM o""",
)
def load_all(spark, sf_dir):
    return load_results(_order_results(spark, sf_dir), {"intake": "all"})


@query(
    "load_results_label",
    _ORDERS_CTE + " SELECT record_id, CAST(price * 2 AS VARCHAR) AS amount FROM o WHERE state = 'F'",
)
def load_label(spark, sf_dir):
    return load_results(_order_results(spark, sf_dir), {"billing": "amount"})


@query(
    "load_results_rename",
    _ORDERS_CTE + """ SELECT record_id, priority, CASE WHEN price > 20000000 THEN concat(state, '-L') END AS kind, CAST(price * 2 AS VARCHAR) AS amount,
      CASE WHEN state = 'F' THEN 'billed' WHEN price > 20000000 THEN 'large' ELSE state END AS state FROM o""",
)
def load_renamed(spark, sf_dir):
    spec = {"intake": ["priority", {"kind": "grade", "state": "status"}], "billing": {"amount": "amount", "state": "status"}}
    store = _order_store(spark, sf_dir)
    loaded = load_results(store, spec)
    # Every order has a price in ``intake``; ``amount`` covers the billed ones alone.
    price = load_results(store, {"intake": {"price": "price"}})
    both = loaded.join(price, KEY)
    return both.select(KEY, "priority", "kind", (F.col("price").cast("long") * 2).cast("string").alias("amount"), "state")


@query(
    "load_results_ids",
    _ORDERS_CTE + " SELECT record_id, CASE WHEN state = 'F' THEN CAST(price * 2 AS VARCHAR) END AS amount FROM o",
)
def load_with_ids(spark, sf_dir):
    ids = keyed_records(table(spark, sf_dir, "orders"), "o_orderkey", [])
    return load_results(_order_results(spark, sf_dir), {"billing": "amount"}, ids=ids)


_LATEST = _ORDERS_CTE + """ SELECT 'intake' AS pipeline, record_id, 'status' AS label, CASE WHEN price > 20000000 THEN 'large' ELSE state END AS value FROM o
    UNION ALL SELECT 'intake', record_id, 'priority', priority FROM o
    UNION ALL SELECT 'intake', record_id, 'price', CAST(price AS VARCHAR) FROM o
    UNION ALL SELECT 'intake', record_id, 'grade', concat(state, '-L') FROM o WHERE price > 20000000
    UNION ALL SELECT 'billing', record_id, 'status', 'billed' FROM o WHERE state = 'F'
    UNION ALL SELECT 'billing', record_id, 'amount', CAST(price * 2 AS VARCHAR) FROM o WHERE state = 'F'"""


@query("latest_results", _LATEST)
def last(spark, sf_dir):
    return latest(_order_results(spark, sf_dir))


@query("latest_store", _LATEST)
def last_stored(spark, sf_dir):
    return latest(_order_store(spark, sf_dir))


@query(
    "load_results_store",
    _ORDERS_CTE + " SELECT record_id, concat(state, '-L') AS kind FROM o WHERE price > 20000000",
)
def load_stored_label(spark, sf_dir):
    """A single label of one step: a projection of its partition."""
    return load_results(_order_store(spark, sf_dir), {"intake": {"kind": "grade"}})


@query(
    "store_labels",
    _ORDERS_CTE + """ SELECT 'intake' AS pipeline, 'Read' AS step, label, count(*) AS n FROM o, (VALUES ('status'), ('priority'), ('price')) l(label) GROUP BY label
    UNION ALL SELECT 'intake', 'Grade', label, count(*) FROM o, (VALUES ('status'), ('grade')) l(label) WHERE price > 20000000 GROUP BY label
    UNION ALL SELECT 'billing', 'Bill', label, count(*) FROM o, (VALUES ('status'), ('amount')) l(label) WHERE state = 'F' GROUP BY label""",
)
def catalogue(spark, sf_dir):
    return _order_store(spark, sf_dir).labels.select("pipeline", "step", "label", "n")


@query(
    "store_versions",
    _ORDERS_CTE + """ SELECT CAST(1 AS BIGINT) AS version, record_id, state AS value FROM o
    UNION ALL SELECT 2, record_id, lower(state) FROM o WHERE price > 20000000
    UNION ALL SELECT 3, record_id, lower(state) FROM o WHERE price > 20000000 AND state <> 'F'""",
)
def versions(spark, sf_dir):
    """What readers of each version see: the first write, a re-run, and the store after ids were removed."""
    path = scratch_path(spark, "results")
    read = _order_results(spark, sf_dir).where("step = 'Read' AND label = 'status'")
    large = keyed_records(table(spark, sf_dir, "orders"), "o_orderkey", {"price": cents("o_totalprice"), "state": F.col("o_orderstatus")})
    write_results(read, path)
    again = read.join(large.where("price > 20000000").select(KEY), KEY, "left_semi")
    write_results(again.withColumn("value", F.lower("value")), path, pipeline="intake")
    remove_from_store(spark, path, large.where("state = 'F'").select(KEY))
    seen = [read_results(spark, path, v).select(F.lit(v).cast("long").alias("version"), KEY, "value") for v in (1, 2, 3)]
    return seen[0].union(seen[1]).union(seen[2])


@query(
    "results_store",
    _ORDERS_CTE + """ SELECT 'Grade' AS step, label, count(*) AS n, count(DISTINCT record_id) AS n_records
    FROM o, (VALUES ('status'), ('grade')) l(label) WHERE price > 20000000 GROUP BY label""",
)
def stored(spark, sf_dir):
    path = scratch_path(spark, "results")
    results = _order_results(spark, sf_dir)
    write_results(results, path)
    write_results(results.where("step = 'Grade'"), path)
    store = read_results(spark, path).where("pipeline = 'intake' AND step = 'Grade'")
    by_label = store.groupBy("step", "label", KEY).agg(F.count(F.lit(1)).alias("n")).groupBy("step", "label")
    return by_label.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_records"))


@query(
    "remove_ids",
    """SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS record_id, lang AS value FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR), CAST(quality AS VARCHAR) FROM labels WHERE toxic <> 1""",
)
def removed(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", {"value": F.col("lang")})
    labels = keyed_records(table(spark, sf_dir, "labels"), "doc_id", {"value": F.col("quality").cast("string")})
    toxic = keyed_records(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", [])
    left = remove_ids([documents, labels], toxic)
    named = [df.select(F.lit(name).alias("origin"), KEY, "value") for df, name in zip(left, ("documents", "labels"))]
    return named[0].union(named[1])


def _part_tree(spark, sf_dir):
    """Requirement edges of the binary tree over part keys."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst")).where("src <> dst")


def _small_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))


_REACHED = """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey // 2 <> p_partkey),
  r AS (SELECT p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT e.dst FROM e JOIN r ON e.src = r.node)"""


@query(
    "purge_steps",
    _REACHED + """ SELECT l_partkey AS step, count(*) AS n_rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem WHERE l_partkey NOT IN (SELECT node FROM r) GROUP BY 1""",
)
def purged(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select(
        F.lit("parts").alias("pipeline"), F.col("l_partkey").alias("step"), F.lit(1).alias("step_no"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias(KEY), F.lit("quantity").alias("label"),
        F.col("l_quantity").cast("long").cast("string").alias("value"),
    )
    left = purge_steps(results, _part_tree(spark, sf_dir), _small_parts(spark, sf_dir))
    return left.groupBy("step").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("value").cast("long")).alias("quantity"))


@query(
    "lineage_levels",
    """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey // 2 <> p_partkey
        UNION ALL SELECT p_partkey, p_partkey + 1000000 FROM part WHERE p_size > 40),
    l AS (SELECT DISTINCT src AS node, CAST(0 AS BIGINT) AS level FROM e WHERE src NOT IN (SELECT dst FROM e)
      UNION SELECT e.dst, l.level + 1 FROM e JOIN l ON e.src = l.node)
    SELECT node, max(level) AS level FROM l GROUP BY 1""",
)
def topological(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 40")
    more = parts.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1000000).alias("dst"))
    return levels(_part_tree(spark, sf_dir).union(more))


@query("lineage_downstream", _REACHED + " SELECT node FROM r")
def affected(spark, sf_dir):
    return downstream(_part_tree(spark, sf_dir), _small_parts(spark, sf_dir))


@query(
    "lineage_cycles",
    """WITH RECURSIVE c AS (SELECT max(p_partkey) AS node FROM part UNION ALL SELECT node // 2 FROM c WHERE node > 1)
    SELECT node FROM c""",
)
def cycles(spark, sf_dir):
    last_part = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("src"), F.lit(1).cast("long").alias("dst"))
    return cyclic_nodes(_part_tree(spark, sf_dir).union(last_part))


def _uses(spark, sf_dir):
    """Requirements along the part tree and a dependency of every part on the next one."""
    parts = table(spark, sf_dir, "part")
    tree = _part_tree(spark, sf_dir).withColumn("kind", F.lit("requires"))
    return tree.union(parts.select("p_partkey", F.col("p_partkey") + 1, F.lit("depends")))


_USES = """e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst, 'requires' AS kind FROM part WHERE p_partkey // 2 <> p_partkey
  UNION ALL SELECT p_partkey, p_partkey + 1, 'depends' FROM part)"""


@query(
    "lineage_unresolved",
    "WITH " + _USES + """, named AS (SELECT CASE kind WHEN 'depends' THEN src ELSE dst END AS step,
      CASE kind WHEN 'depends' THEN dst ELSE src END AS missing, kind FROM e)
    SELECT step, missing, kind FROM named WHERE missing NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""",
)
def unknown(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node"))
    return unresolved(_uses(spark, sf_dir), known)


@query(
    "lineage_mixed_kinds",
    "WITH " + _USES + """, n AS (SELECT p_partkey AS node, CASE WHEN p_size > 45 THEN 'set' ELSE 'row' END AS kind FROM part)
    SELECT e.src AS step, a.kind AS step_kind, e.dst AS dependency, b.kind AS dependency_kind
    FROM e JOIN n a ON e.src = a.node JOIN n b ON e.dst = b.node WHERE e.kind = 'depends' AND a.kind <> b.kind""",
)
def mixed(spark, sf_dir):
    kind = F.when(F.col("p_size") > 45, "set").otherwise("row")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), kind.alias("kind"))
    return mixed_kinds(_uses(spark, sf_dir), nodes)


@query(
    "lineage_chain",
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey // 2 <> p_partkey
        UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey >= 4),
    c AS (SELECT src AS step, dst AS dependency, CAST(1 AS BIGINT) AS depth FROM e
      UNION SELECT c.step, e.dst, c.depth + 1 FROM c JOIN e ON c.dependency = e.src)
    SELECT step, dependency, max(depth) AS depth FROM c GROUP BY 1, 2""",
)
def chains(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    parents = _part_tree(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    grand = parts.where("p_partkey >= 4").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 4").alias("dst"))
    return dependency_chain(parents.union(grand))


def _priced(records):
    stepped = map_step(
        records, "Price", run={"amount": cents("value"), "kind": F.upper("event_type")}, condition=F.col("event_type") != "error"
    )
    return stepped.select(KEY, "Price.amount", "Price.kind", F.col("Price_ran").alias("ran"))


_PRICED = """SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS amount,
  CASE WHEN event_type <> 'error' THEN upper(event_type) END AS kind, event_type <> 'error' AS ran FROM events"""


def _incremental(spark, sf_dir, overlap, skip_done):
    """Two drops of events, each taken up by its own run."""
    events = keyed_records(table(spark, sf_dir, "events"), "event_id", ["event_type", "value", "user_id"])
    early = F.col("user_id") <= 20
    base = scratch_path(spark, "incremental")
    drops = [events.where(early), events if overlap else events.where(~early)]
    for drop in drops:
        drop.write.mode("append").parquet(f"{base}/in")
        run_incremental(spark, f"{base}/in", events.schema, _priced, f"{base}/out", f"{base}/checkpoint", skip_done)
    return spark.read.parquet(f"{base}/out")


@query("incremental_run", _PRICED)
def incremental(spark, sf_dir):
    return _incremental(spark, sf_dir, overlap=False, skip_done=False)


@query("incremental_skip_done", _PRICED)
def incremental_overlap(spark, sf_dir):
    return _incremental(spark, sf_dir, overlap=True, skip_done=True)
