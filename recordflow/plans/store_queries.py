"""Queries on stored results after changes, on exact values in Python steps, and on steps that only some records run."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators.checks import delete_temp, missing_outputs, temp_files
from recordflow.operators.records import KEY, keyed_records
from recordflow.operators.runlog import logged_step
from recordflow.operators.steps import did_run, has_run, map_step, map_step_py
from recordflow.plans.registry import cents, query, table
from recordflow.plans.step_queries import TEMPORARY, temporary_manifest
from recordflow.sources.files import list_files
from recordflow.sources.loader import load_records
from recordflow.sources.results import export_plan, load_results, purge_store, read_results, remove_from_store, write_results
from recordflow.storage import scratch_path
from recordflow.streaming.incremental import run_incremental


def _by_source(spark, sf_dir):
    """Results of one step for each source of the documents."""
    return table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("pipeline"), F.col("source").alias("step"), F.lit(1).alias("step_no"),
        F.col("doc_id").cast("string").alias(KEY), F.lit("lang").alias("label"), F.col("lang").alias("value"))


@query(
    "purge_store",
    """WITH RECURSIVE n AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS k FROM documents),
      r AS (SELECT CAST(3 AS BIGINT) AS k UNION SELECT n.k FROM n JOIN r ON n.k // 2 = r.k AND n.k <> r.k)
    SELECT source AS step, count(*) AS n_rows FROM documents WHERE CAST(substr(source, 4) AS BIGINT) NOT IN (SELECT k FROM r) GROUP BY 1""",
)
def purged_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    write_results(_by_source(spark, sf_dir), path)
    number = F.substring("step", 4, 10).cast("long")
    steps = _by_source(spark, sf_dir).select("step").distinct()
    edges = steps.select(F.concat(F.lit("src"), F.expr("cast(substring(step, 4) as long) div 2").cast("string")).alias("src"),
                         F.col("step").alias("dst")).where("src <> dst")
    purge_store(spark, path, edges, steps.where(number == 3).select(F.col("step").alias("node")))
    return read_results(spark, path).groupBy("step").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "remove_from_store",
    "SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS step, lang AS value FROM documents WHERE lang <> 'de' AND source <> 'src5'",
)
def cleaned_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    write_results(_by_source(spark, sf_dir), path)
    gone = _by_source(spark, sf_dir).where("value = 'de' or step = 'src5'").select(KEY)
    remove_from_store(spark, path, gone)
    return read_results(spark, path).select(KEY, "step", "value")


@query(
    "rerun_replaces",
    "SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS step FROM documents WHERE lang = 'en' AND source NOT IN ('src1', 'src2')",
)
def replaced_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    results = _by_source(spark, sf_dir)
    write_results(results, path)
    write_results(results.where("value = 'en' and step not in ('src1', 'src2')"), path, pipeline="docs")
    return read_results(spark, path).select(KEY, "step")


@query(
    "load_results_many_labels",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN source IN ('src1', 'src3') THEN lang END AS odd, CASE WHEN source = 'src2' THEN lang END AS even
    FROM documents WHERE source IN ('src1', 'src2', 'src3')""",
)
def some_of_many_labels(spark, sf_dir):
    """A label for each source; those asked for are shared by a part of the documents that grows with them."""
    results = _by_source(spark, sf_dir).withColumns({"label": F.col("step"), "step": F.lit("Sort")})
    return load_results(results, {"docs": [{"odd": "src1", "even": "src2"}, {"odd": "src3"}]})


# Values beyond the exact range of doubles, beside NULLs.
_LARGE = "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 9007199254740992 END"


def _large(spark, sf_dir):
    q = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + 9007199254740992)
    return keyed_records(table(spark, sf_dir, "orders"), "o_orderkey", {"q": q, "status": F.col("o_orderstatus")})


@query(
    "map_step_py_nulls",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CASE WHEN o_orderstatus = 'F' THEN {_LARGE} + 1 END AS r FROM orders",
)
def exact_frames(spark, sf_dir):
    stepped = map_step_py(_large(spark, sf_dir), "Next", lambda b: b.assign(r=b["q"] + 1)[["r"]], "r long", ["q"], condition=F.col("status") == "F")
    return stepped.select(KEY, "Next.r")


def _next_value(values):
    return {"r": None if values["q"] is None else values["q"] + 1}


@query(
    "logged_step_nulls",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CASE WHEN o_orderstatus = 'F' THEN {_LARGE} + 1 END AS r FROM orders",
)
def exact_rows(spark, sf_dir):
    stepped = logged_step(_large(spark, sf_dir), "Next", _next_value, "r long", ["q"], condition=F.col("status") == "F")
    return stepped.select(KEY, "Next.r")


def _load_order(part):
    yield {KEY: part["o_orderkey"], "q": part["q"], "known": part["q"] is not None}


@query(
    "load_records_nulls",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, {_LARGE} AS q, {_LARGE} IS NOT NULL AS known FROM orders",
)
def exact_loads(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + 9007199254740992).alias("q"))
    return load_records(parts, _load_order, f"{KEY} string, q long, known boolean")


def _written(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["lang", "n_chars"])
    path = F.concat(F.lit("/work/"), F.col(KEY), F.lit(".v1.txt"))
    return map_step(documents, "Write", declare={"path": path}, condition=F.col("lang") == "en")


@query(
    "missing_outputs_conditional",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, 'Write' AS step, 'path' AS label, concat('/work/', doc_id, '.v1.txt') AS path
    FROM documents WHERE lang = 'en' AND n_chars <= 1000""",
)
def lost_where_run(spark, sf_dir):
    stepped = _written(spark, sf_dir)
    manifest = stepped.where("n_chars > 1000").select("Write.path")
    return missing_outputs(stepped, "Write", {"path": F.col("Write.path")}, manifest)


@query(
    "has_run_no_labels",
    "SELECT CAST(doc_id AS VARCHAR) AS record_id, true AS has, lang = 'en' AS did FROM documents",
)
def run_without_labels(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["lang"])
    stepped = map_step(documents, "Touch", condition=F.col("lang") == "en")
    return stepped.select(KEY, has_run(stepped, "Touch").alias("has"), did_run(stepped, "Touch").alias("did"))


@query(
    "export_paths",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, 'path' AS label, concat('/work/', doc_id, '.v1.txt') AS source,
      concat('/results/', doc_id, '.v1.Write.txt') AS target FROM documents WHERE lang = 'en'""",
)
def planned_copies(spark, sf_dir):
    return export_plan(_written(spark, sf_dir), "Write", ["path"], "/results")


@query(
    "temp_files",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, concat('spill-', lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0'), '.part') AS path FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), concat('postings/x/', doc_id, '/7.idx') FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), concat('lock-', doc_id, '-', source) FROM documents WHERE source <> 'src5'""",
)
def files_to_delete(spark, sf_dir):
    return temp_files(temporary_manifest(spark, sf_dir), TEMPORARY)


@query(
    "delete_temp",
    "SELECT source, count(*) AS n_rows, 0::BIGINT AS deleted_again FROM documents WHERE NOT regexp_full_match(source, 'src1.') GROUP BY source",
)
def deleted_files(spark, sf_dir):
    """A folder for each source, those of a glob deleted; a second run finds nothing to delete."""
    path = scratch_path(spark, "folders")
    table(spark, sf_dir, "documents").select("doc_id", "source").write.partitionBy("source").parquet(path)
    inside = F.regexp_extract("path", "(source=[^/]*/[^/]*)$", 1)

    def run():
        manifest = list_files(spark, path, recursive=True).where("path LIKE '%.parquet'").select(F.lit("").alias(KEY), "path", inside.alias("inside"))
        return delete_temp(manifest, ["source=src1?/part-*"], "inside", location="path").where("deleted").count()

    again = [run(), run()][1]
    left = spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return left.withColumn("deleted_again", F.lit(again).cast("long"))


@query(
    "incremental_done_not_run",
    "SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(round(value * 100) AS BIGINT) AS amount FROM events",
)
def done_ids_are_not_run(spark, sf_dir):
    """The step fails on any event of the first drop that comes again."""
    events = keyed_records(table(spark, sf_dir, "events"), "event_id", ["value", "user_id"])
    early, base = F.col("user_id") <= 20, scratch_path(spark, "incremental")

    def steps(records):
        again = (F.col("drop") == 2) & early
        amount = F.when(again, F.raise_error("done before").cast("long")).otherwise(cents("value"))
        return records.select(KEY, amount.alias("amount"))

    schema = events.withColumn("drop", F.lit(1)).schema
    for drop, rows in ((1, events.where(early)), (2, events)):
        rows.withColumn("drop", F.lit(drop)).write.mode("append").parquet(f"{base}/in")
        run_incremental(spark, f"{base}/in", schema, steps, f"{base}/out", f"{base}/checkpoint", skip_done=True, max_files=3)
    return spark.read.parquet(f"{base}/out")
