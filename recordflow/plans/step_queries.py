"""Per-record steps, checks and clean-up over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators.checks import drop_temp, mark_complete, missing_exports, missing_outputs, split_complete
from recordflow.operators.records import KEY, keyed_records
from recordflow.operators.runlog import logged_step, run_log, split_errors
from recordflow.operators.sets import keep_where
from recordflow.operators.steps import (
    Dependency,
    bind_inputs,
    did_run,
    has_run,
    map_step,
    map_step_py,
    pipe_step,
)
from recordflow.plans.registry import cents, query, table, words
from recordflow.sources.results import export_results


def _documents(spark, sf_dir, labels=("text", "lang", "source", "n_chars")):
    return keyed_records(table(spark, sf_dir, "documents"), "doc_id", list(labels))


def _orders(spark, sf_dir):
    labels = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "price": cents("o_totalprice")}
    return keyed_records(table(spark, sf_dir, "orders"), "o_orderkey", labels)


@query(
    "map_step",
    r"""SELECT CAST(doc_id AS VARCHAR) AS record_id,
      CAST(len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) AS BIGINT) AS n_words,
      CAST(length(text) AS BIGINT) AS text_length, TRUE AS ran FROM documents""",
)
def mapped(spark, sf_dir):
    measure = {"n_words": F.size(words("text")).cast("long"), "text_length": F.length("text").cast("long")}
    stepped = map_step(_documents(spark, sf_dir), "Measure", run=measure)
    return stepped.select(KEY, "Measure.n_words", "Measure.text_length", F.col("Measure_ran").alias("ran"))


@query(
    "map_step_py",
    """SELECT CAST(o_orderkey AS VARCHAR) AS record_id,
      CASE WHEN o_orderstatus = 'F'
        THEN CAST(list_sum(list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c, i: i * CAST(c AS BIGINT))) AS BIGINT) END AS weight
    FROM orders""",
)
def mapped_py(spark, sf_dir):
    def weights(batch):
        return batch[[]].assign(weight=batch[KEY].map(lambda key: sum(i * int(c) for i, c in enumerate(key, 1))))

    stepped = map_step_py(
        _orders(spark, sf_dir), "DigitWeight", weights, "weight long", [KEY], condition=F.col("status") == "F"
    )
    return stepped.select(KEY, "DigitWeight.weight")


@query(
    "pipe_step",
    "SELECT CAST(p_partkey AS VARCHAR) AS record_id, replace(p_name, 'ring', 'rung') AS result FROM part",
)
def piped(spark, sf_dir):
    parts = keyed_records(table(spark, sf_dir, "part"), "p_partkey", {"name": F.col("p_name")})
    return pipe_step(parts, "Sed", ["sed", "s/ring/rung/g"], F.col("name")).select(KEY, "Sed.result")


@query(
    "conditional_step",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, n_chars * 2 AS declared,
      CASE WHEN lang = 'en' THEN source END AS seen_in, lang = 'en' AS ran FROM documents""",
)
def conditional(spark, sf_dir):
    stepped = map_step(
        _documents(spark, sf_dir), "Step", declare={"declared": F.col("n_chars") * 2}, run={"seen_in": F.col("source")},
        condition=F.col("lang") == "en",
    )
    return stepped.select(KEY, "Step.declared", "Step.seen_in", F.col("Step_ran").alias("ran"))


@query(
    "skip_step",
    """SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_name AS declared, CAST(NULL AS VARCHAR) AS produced, FALSE AS ran FROM customer""",
)
def skipped(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"])
    stepped = map_step(
        customers, "Step", declare={"declared": F.col("c_name")}, run={"produced": F.col("c_mktsegment")}, skip="True"
    )
    return stepped.select(KEY, "Step.declared", "Step.produced", F.col("Step_ran").alias("ran"))


@query(
    "skip_step_export",
    "SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'kept' AS label, c_mktsegment AS value FROM customer",
)
def skipped_export(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"])
    stepped = map_step(customers, "Off", run={"lost": F.col("c_mktsegment")}, skip="true")
    stepped = map_step(stepped, "On", run={"kept": F.col("c_mktsegment")}, skip="no")
    exported = export_results(stepped, "Off", ["lost"], "run", 1).union(export_results(stepped, "On", ["kept"], "run", 2))
    return exported.select(KEY, "label", "value")


@query(
    "bind_inputs",
    """SELECT CAST(c_custkey AS VARCHAR) AS record_id, concat(c_name, '/', c_mktsegment) AS alias, c_mktsegment AS name,
      concat(c_name, '/', c_mktsegment) AS joined FROM customer""",
)
def bound(spark, sf_dir):
    customers = keyed_records(
        table(spark, sf_dir, "customer"), "c_custkey", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}
    )
    stepped = map_step(customers, "Join", run={"joined": F.concat_ws("/", "name", "segment")})
    return bind_inputs(stepped, {"Join": {"joined": "alias"}, "root": {"segment": "name"}}).select(
        KEY, "alias", "name", "Join.joined"
    )


def _length_of_text(records, gate):
    """Reusable step: the length of whatever is bound to ``text``."""
    return map_step(records, "Length", run={"n": F.length("text").cast("long")}, gate=gate)


@query(
    "use_step_rename",
    """SELECT CAST(p_partkey AS VARCHAR) AS record_id, CAST(length(p_name) AS BIGINT) AS name_length,
      CASE WHEN p_size > 25 THEN CAST(length(p_type) AS BIGINT) END AS type_length, p_brand AS text,
      CASE WHEN p_size > 25 THEN CAST(length(p_name) + length(p_type) AS BIGINT) END AS total FROM part""",
)
def reused_twice(spark, sf_dir):
    parts = keyed_records(
        table(spark, sf_dir, "part"), "p_partkey",
        {"name": F.col("p_name"), "kind": F.col("p_type"), "text": F.col("p_brand"), "size": F.col("p_size")},
    )
    uses_name = Dependency(_length_of_text, {"root": {"name": "text"}}, {"Length": "NameLength"})
    uses_kind = Dependency(_length_of_text, {"root": {"kind": "text"}}, {"Length": "TypeLength"})
    stepped = map_step(parts, "Measure", depends=[uses_name])
    stepped = map_step(
        stepped, "Total", run={"total": F.col("NameLength.n") + F.col("TypeLength.n")}, depends=[uses_kind],
        condition=F.col("size") > 25,
    )
    return stepped.select(
        KEY, F.col("NameLength.n").alias("name_length"), F.col("TypeLength.n").alias("type_length"), "text", "Total.total"
    )


def _surcharge(records, gate):
    return map_step(records, "Surcharge", declare={"seen": F.col("amount")}, run={"value": F.col("amount") + 3}, gate=gate)


def _doubled(records, gate):
    below = Dependency(_surcharge)
    return map_step(
        records, "Doubled", run={"value": F.col("Surcharge.value") * 2}, depends=[below], gate=gate
    )


def _billed(records, gate):
    below = Dependency(_doubled)
    return map_step(
        records, "Billed", declare={"amount": F.col("amount")}, run={"value": F.col("Doubled.value") + 1},
        depends=[below], gate=gate,
    )


@query(
    "use_step_chain",
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_orderstatus = 'F' AS ran FROM orders)
    SELECT record_id, p AS declared, p AS deepest_declared, CASE WHEN ran THEN p + 3 END AS surcharge,
      CASE WHEN ran THEN (p + 3) * 2 END AS doubled, CASE WHEN ran THEN (p + 3) * 2 + 1 END AS billed,
      CASE WHEN ran THEN (p + 3) * 2 + 1 - p END AS result, ran FROM o""",
)
def chain(spark, sf_dir):
    stepped = map_step(_orders(spark, sf_dir), "Priced", run={"price": F.col("price")})
    uses = Dependency(_billed, {"Priced": {"price": "amount"}})
    stepped = map_step(
        stepped, "Change", run={"result": F.col("Billed.value") - F.col("Billed.amount")}, depends=[uses],
        condition=F.col("status") == "F",
    )
    return stepped.select(
        KEY, F.col("Billed.amount").alias("declared"), F.col("Surcharge.seen").alias("deepest_declared"),
        F.col("Surcharge.value").alias("surcharge"), F.col("Doubled.value").alias("doubled"),
        F.col("Billed.value").alias("billed"), "Change.result", F.col("Surcharge_ran").alias("ran"),
    )


@query(
    "has_run_counts",
    """SELECT o_orderpriority AS priority, count(*) AS has_first, count(*) FILTER (o_orderstatus = 'F') AS did_first,
      CAST(0 AS BIGINT) AS has_unknown FROM orders GROUP BY 1""",
)
def has_run_counts(spark, sf_dir):
    stepped = map_step(_orders(spark, sf_dir), "First", run={"status": F.col("status")}, condition=F.col("status") == "F")
    return stepped.groupBy("priority").agg(
        F.count_if(has_run(stepped, "First")).alias("has_first"),
        F.count_if(did_run(stepped, "First")).alias("did_first"),
        F.count_if(has_run(stepped, "Unknown")).alias("has_unknown"),
    )


@query(
    "keep_where",
    "SELECT c_name AS record_id, c_mktsegment AS segment FROM customer WHERE c_name > 'Customer#00000004' AND c_mktsegment <> 'BUILDING'",
)
def kept(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_name", {"segment": F.col("c_mktsegment")})
    return keep_where(customers, (F.col(KEY) > "Customer#00000004") & (F.col("segment") != "BUILDING"))


@query(
    "keep_where_py",
    "SELECT c_name AS record_id, c_mktsegment AS segment FROM customer WHERE c_mktsegment LIKE '%U%'",
)
def kept_py(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_name", {"segment": F.col("c_mktsegment")})
    return keep_where(customers, lambda batch: batch["segment"].str.contains("U", regex=False), ["segment"])


def _outputs(spark, sf_dir):
    """Documents with the two files a step should leave for each."""
    paths = {
        "lang": F.col("lang"),
        "report": F.concat(F.lit("out/"), "doc_id", F.lit(".txt")),
        "detail": F.concat(F.lit("out/"), "doc_id", F.lit(".json")),
    }
    return keyed_records(table(spark, sf_dir, "documents"), "doc_id", paths)


def _manifest(spark, sf_dir):
    """Files that exist: a report for each labelled document, details for the good ones."""
    suffixes = F.when(F.col("quality") == 1, F.array(F.lit(".txt"), F.lit(".json"))).otherwise(F.array(F.lit(".txt")))
    files = table(spark, sf_dir, "labels").select("doc_id", F.explode(suffixes).alias("suffix"))
    return files.select(F.concat(F.lit("out/"), "doc_id", "suffix").alias("path"))


@query(
    "resume_todo",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, lang FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def todo(spark, sf_dir):
    return split_complete(_outputs(spark, sf_dir), _manifest(spark, sf_dir), ["report", "detail"])[1].select(KEY, "lang")


@query(
    "resume_done",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, lang FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def done(spark, sf_dir):
    return split_complete(_outputs(spark, sf_dir), _manifest(spark, sf_dir), ["report", "detail"])[0].select(KEY, "lang")


@query(
    "resume_step",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, 'report' AS label, concat('out/', doc_id, '.txt') AS value, doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AS computed
    FROM documents WHERE lang <> 'fr'""",
)
def resumed(spark, sf_dir):
    records = mark_complete(_outputs(spark, sf_dir), _manifest(spark, sf_dir), ["report", "detail"])
    stepped = map_step(
        records, "Write", declare={"report": F.col("report")}, run={"computed": F.lit(True)},
        condition=F.col("lang") != "fr", complete=F.col("complete"),
    )
    exported = export_results(stepped, "Write", ["report"], "run", 1)
    computed = stepped.select(KEY, F.coalesce("Write.computed", F.lit(False)).alias("computed"))
    return exported.join(computed, KEY).select(KEY, "label", "value", "computed")


@query(
    "missing_outputs",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, 'Report' AS step, 'report' AS label, concat('out/', doc_id, '.txt') AS path
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL
    SELECT CAST(doc_id AS VARCHAR), 'Report', 'detail', concat('out/', doc_id, '.json')
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def lost(spark, sf_dir):
    return missing_outputs(_outputs(spark, sf_dir), "Report", ["report", "detail"], _manifest(spark, sf_dir))


@query(
    "missing_exports",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, 'Grade' AS step, 'size_class' AS label
    FROM documents WHERE lang <> 'de' AND n_chars <= 1000""",
)
def lost_exports(spark, sf_dir):
    grade = {"size_class": F.when(F.col("n_chars") > 1000, "large"), "lang": F.col("lang")}
    stepped = map_step(_documents(spark, sf_dir), "Grade", run=grade, condition=F.col("lang") != "de")
    return missing_exports(stepped, "Grade", ["size_class", "lang"])


# Globs of what an indexing step leaves behind: numbered spills, the postings of a document, locks of all but one source.
TEMPORARY = ["spill-??.part", "postings/*/{record_id}/[0-9].idx", "lock-{record_id}-src[!5]*"]


def temporary_manifest(spark, sf_dir):
    """Files of each document, those of ``TEMPORARY`` among them."""
    places = {
        "spill-%02d.part": F.col("doc_id") % 100, "spill-%03d.part": F.col("doc_id") % 1000, "table-%d.parquet": F.col("doc_id"),
        "postings/x/%d/7.idx": F.col("doc_id"), "postings/x/%d/a.idx": F.col("doc_id"), "postings/y/%d/7.idx": F.col("doc_id") + 1,
    }
    names = [F.format_string(form, number) for form, number in places.items()]
    names.append(F.concat(F.lit("lock-"), F.col("doc_id").cast("string"), F.lit("-"), "source"))
    manifest = keyed_records(table(spark, sf_dir, "documents"), "doc_id", {"path": F.array(*names)})
    return manifest.select(KEY, F.explode("path").alias("path"))


@query(
    "drop_temp",
    """WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, unnest([
        concat('spill-', lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0'), '.part'), concat('spill-', lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), '.part'),
        concat('table-', doc_id, '.parquet'), concat('postings/x/', doc_id, '/7.idx'), concat('postings/x/', doc_id, '/a.idx'),
        concat('postings/y/', doc_id + 1, '/7.idx'), concat('lock-', doc_id, '-', source)
      ]) AS path FROM documents)
    SELECT record_id, path FROM m
    WHERE NOT (regexp_full_match(path, 'spill-[^/][^/][.]part') OR regexp_full_match(path, concat('postings/[^./][^/]*/', record_id, '/[0-9][.]idx'))
      OR regexp_full_match(path, concat('lock-', record_id, '-src[^5/][^/]*')))""",
)
def cleaned(spark, sf_dir):
    return drop_temp(temporary_manifest(spark, sf_dir), TEMPORARY)


def _strict_half(values):
    """Row function that refuses odd quantities."""
    if values["quantity"] % 2:
        raise ValueError(f"odd quantity {values['quantity']}")
    return {"half": values["quantity"] // 2}


def _sized_parts(spark, sf_dir):
    labels = {"quantity": F.col("p_size").cast("long"), "brand": F.col("p_brand")}
    return keyed_records(table(spark, sf_dir, "part"), "p_partkey", labels)


@query(
    "capture_errors",
    """SELECT CAST(p_partkey AS VARCHAR) AS record_id, concat('ValueError: odd quantity ', p_size) AS error FROM part
    WHERE p_size % 2 = 1 AND p_brand <> 'Brand#1'""",
)
def captured(spark, sf_dir):
    stepped = logged_step(
        _sized_parts(spark, sf_dir), "Half", _strict_half, "half long", ["quantity"],
        condition=F.col("brand") != "Brand#1", mode="quarantine",
    )
    return split_errors(stepped, "Half")[1].select(KEY, "Half_log.error")


@query(
    "capture_errors_good",
    """SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_brand <> 'Brand#1' THEN CAST(p_size // 2 AS BIGINT) END AS half FROM part
    WHERE p_size % 2 = 0 OR p_brand = 'Brand#1'""",
)
def captured_good(spark, sf_dir):
    stepped = logged_step(
        _sized_parts(spark, sf_dir), "Half", _strict_half, "half long", ["quantity"],
        condition=F.col("brand") != "Brand#1", mode="quarantine",
    )
    return split_errors(stepped, "Half")[0].select(KEY, "Half.half")


@query(
    "run_log",
    """SELECT 'parts' AS pipeline, 'Half' AS step, CAST(p_partkey AS VARCHAR) AS record_id,
      CASE WHEN p_brand = 'Brand#1' THEN 'skipped' WHEN p_size % 2 = 1 THEN 'failed' ELSE 'ok' END AS status,
      p_brand <> 'Brand#1' AS timed FROM part""",
)
def logged(spark, sf_dir):
    stepped = logged_step(
        _sized_parts(spark, sf_dir), "Half", _strict_half, "half long", ["quantity"],
        condition=F.col("brand") != "Brand#1", mode="quarantine",
    )
    log = run_log(stepped, "Half", "parts")
    return log.select("pipeline", "step", KEY, "status", F.coalesce(F.col("seconds") >= 0, F.lit(False)).alias("timed"))
