"""Record sets, files and sequence formats over the test tables."""

from __future__ import annotations

import json
import re

from pyarrow import fs
from pyspark.sql import functions as F

from recordflow.operators.records import KEY, check_keys, input_ids, keyed_records, merge_records, union_ids
from recordflow.operators.sets import rollup_content
from recordflow.plans.registry import query, table
from recordflow.sources.files import files_to_records, list_files, stage_input
from recordflow.sources.loader import load_records
from recordflow.sources.sequences import fasta_lines, fastq_lines, read_fasta, read_fastq, read_gff3, write_lines
from recordflow.sources.user_source import load_source
from recordflow.storage import scratch_path


@query(
    "keyed_records",
    "SELECT CAST(doc_id AS VARCHAR) AS record_id, lang, source, n_chars FROM documents",
)
def keyed(spark, sf_dir):
    return keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source", "n_chars"])


def _lines_by_order(spark, sf_dir):
    key = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))
    quantity = F.col("l_quantity").cast("long")
    return keyed_records(table(spark, sf_dir, "lineitem"), key, {"quantity": quantity})


@query(
    "check_keys",
    """SELECT concat(l_orderkey, '-', l_linenumber) AS record_id, 'duplicate' AS defect, count(*) AS n_rows
    FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
)
def bad_keys(spark, sf_dir):
    return check_keys(_lines_by_order(spark, sf_dir))[1]


@query(
    "check_keys_good",
    """WITH k AS (SELECT concat(l_orderkey, '-', l_linenumber) AS record_id, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)
    SELECT record_id, min(quantity) AS quantity FROM k GROUP BY 1 HAVING count(*) = 1""",
)
def good_keys(spark, sf_dir):
    return check_keys(_lines_by_order(spark, sf_dir))[0]


@query(
    "check_keys_space",
    """SELECT p_name AS record_id, d.defect, n_rows FROM (
      SELECT p_name, count(*) AS n_rows,
        list_filter([CASE WHEN contains(p_name, ' ') THEN 'space' END, CASE WHEN count(*) > 1 THEN 'duplicate' END],
                    lambda x: x IS NOT NULL) AS defects
      FROM part GROUP BY 1), unnest(defects) AS d(defect)""",
)
def space_keys(spark, sf_dir):
    return check_keys(keyed_records(table(spark, sf_dir, "part"), "p_name", []))[1]


@query(
    "union_ids",
    """SELECT CAST(user_id AS VARCHAR) AS record_id FROM events
    UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer""",
)
def united(spark, sf_dir):
    return union_ids(
        keyed_records(table(spark, sf_dir, "events"), "user_id", []),
        keyed_records(table(spark, sf_dir, "orders"), "o_custkey", []),
        keyed_records(table(spark, sf_dir, "customer"), "c_custkey", []),
    )


@query(
    "merge_records",
    """WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, lang, n_chars FROM documents WHERE n_chars > 500),
    i AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN quality = 1 THEN 'checked' END AS lang,
                 CAST(toxic AS BIGINT) AS toxic FROM labels)
    SELECT coalesce(i.record_id, b.record_id) AS record_id, coalesce(i.lang, b.lang) AS lang, n_chars, toxic
    FROM b FULL JOIN i ON b.record_id = i.record_id""",
)
def merged(spark, sf_dir):
    base = table(spark, sf_dir, "documents").where("n_chars > 500")
    incoming = {"lang": F.when(F.col("quality") == 1, "checked"), "toxic": F.col("toxic").cast("long")}
    return merge_records(
        keyed_records(base, "doc_id", ["lang", "n_chars"]),
        keyed_records(table(spark, sf_dir, "labels"), "doc_id", incoming),
    )


@query("input_ids", "SELECT CAST(event_id AS VARCHAR) AS record_id FROM events")
def ids(spark, sf_dir):
    return input_ids(keyed_records(table(spark, sf_dir, "events"), "event_id", ["event_type", "value"]))


# File endings of a document by its language: two labels, two mates, none known, one label twice.
ENDINGS = {
    "en": [".fasta", ".gff3"],
    "fr": ["_1.fastq", "_2.fastq"],
    "de": [".txt", ".fa"],
    "es": [".gff", ".gff3"],
}


@query(
    "files_to_records",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id,
      CASE WHEN lang = 'en' THEN concat('/in/', doc_id, '.fasta') WHEN lang = 'de' THEN concat('/in/', doc_id, '.fa') END AS fasta,
      CASE WHEN lang = 'fr' THEN concat('/in/', doc_id, '_1.fastq') END AS fastq_1,
      CASE WHEN lang = 'fr' THEN concat('/in/', doc_id, '_2.fastq') END AS fastq_2,
      CASE WHEN lang IN ('en', 'es') THEN concat('/in/', doc_id, '.gff3') END AS gff3
    FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')""",
)
def from_files(spark, sf_dir):
    endings = F.array().cast("array<string>")
    for lang, suffixes in ENDINGS.items():
        endings = F.when(F.col("lang") == lang, F.array(*[F.lit(s) for s in suffixes])).otherwise(endings)
    named = table(spark, sf_dir, "documents").select("doc_id", F.explode(endings).alias("ending"))
    return files_to_records(named.select(F.concat(F.lit("/in/"), "doc_id", "ending").alias("path")))


@query(
    "stage_input",
    """SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_mktsegment AS segment FROM customer""",
)
def staged(spark, sf_dir):
    customers = keyed_records(table(spark, sf_dir, "customer"), "c_custkey", {"segment": F.col("c_mktsegment")})
    path = scratch_path(spark, "staged")
    stage_input(customers, path)
    return stage_input(customers.where("segment = 'never written'"), path)


def _letters(column):
    return F.regexp_replace(column, "[^A-Za-z]", "")


@query(
    "read_fasta",
    """SELECT concat('doc', doc_id) AS record_id, CAST(length(s) AS BIGINT) AS seq_length, md5(s) AS digest
    FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents)""",
)
def fasta(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id", F.lit(" >from "), "source").alias("id"), _letters("text").alias("seq")
    )
    path = scratch_path(spark, "fasta")
    write_lines(fasta_lines(documents), path)
    return read_fasta(spark, path).select(
        F.col("id").alias("record_id"), F.length("seq").cast("long").alias("seq_length"), F.md5("seq").alias("digest")
    )


@query(
    "read_fastq",
    """SELECT concat('doc', doc_id) AS record_id, md5(s) AS digest, md5(regexp_replace(s, '[AEIOUaeiou]', '@', 'g')) AS qual_digest
    FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents)""",
)
def fastq(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id", F.lit(" from "), "source").alias("id"), _letters("text").alias("seq")
    )
    path = scratch_path(spark, "fastq")
    scored = documents.withColumn("qual", F.regexp_replace("seq", "[AEIOUaeiou]", "@"))
    write_lines(fastq_lines(scored), path)
    return read_fastq(spark, path).select(
        F.col("id").alias("record_id"), F.md5("seq").alias("digest"), F.md5("qual").alias("qual_digest")
    )


@query(
    "read_gff3",
    """WITH p AS (SELECT p_partkey, p_name, p_size, p_size <= 40 AS whole FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS seqid, p_name AS kind, CAST(p_size AS BIGINT) AS ending, FALSE AS malformed,
      concat(p_partkey, chr(9), '.', chr(9), p_name, chr(9), '1', chr(9), p_size, chr(9), '.', chr(9), '+', chr(9), '.', chr(9), 'ID=', p_partkey) AS line
    FROM p WHERE whole
    UNION ALL SELECT NULL, NULL, NULL, TRUE, concat(p_partkey, chr(9), p_name) FROM p WHERE NOT whole""",
)
def gff3(spark, sf_dir):
    fields = ["p_partkey", F.lit("."), "p_name", F.lit("1"), "p_size", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "p_partkey")]
    line = F.when(F.col("p_size") <= 40, F.concat_ws("\t", *fields)).otherwise(F.concat_ws("\t", "p_partkey", "p_name"))
    path = scratch_path(spark, "gff3")
    write_lines(table(spark, sf_dir, "part").select(line.alias("value")), path)
    return read_gff3(spark, path).select(
        "seqid", F.col("type").alias("kind"), F.col("end").cast("long").alias("ending"), "malformed", "line"
    )


@query("list_files", "SELECT DISTINCT concat('segment=', c_mktsegment) AS folder, TRUE AS filled FROM customer")
def listed(spark, sf_dir):
    path = scratch_path(spark, "listed")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    customers.write.partitionBy("segment").parquet(path)
    manifest = list_files(spark, path, recursive=True)
    folder = F.element_at(F.split("path", "/"), -2)
    return manifest.groupBy(folder.alias("folder")).agg((F.min("length") > 0).alias("filled"))


@query(
    "rollup_content",
    """SELECT CAST(conv_id AS VARCHAR) AS record_id, count(*) AS n_seqs, CAST(sum(length(text)) AS BIGINT) AS total_length
    FROM conversations GROUP BY 1""",
)
def rolled_up(spark, sf_dir):
    turns = keyed_records(table(spark, sf_dir, "conversations"), "conv_id", {"seq": F.col("text")})
    return rollup_content(turns)


@query(
    "rollup_by_source",
    """SELECT source, lang, count(*) AS n_seqs, CAST(sum(length(text)) AS BIGINT) AS total_length
    FROM documents GROUP BY 1, 2""",
)
def rolled_up_by_source(spark, sf_dir):
    content = table(spark, sf_dir, "documents").select("source", "lang", F.col("text").alias("seq"))
    return rollup_content(content, by=["source", "lang"])


def _pairs_of(part):
    """Loader of one event: a record for each key of its properties."""
    for label, number in json.loads(part["props"]).items():
        yield {KEY: f"{part['event_id']}.{label}", "label": label, "number": number}


@query(
    "load_records",
    """SELECT concat(event_id, '.', k) AS record_id, k AS label, CAST(json_extract_string(props, '$.' || k) AS BIGINT) AS number
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
)
def loaded(spark, sf_dir):
    parts = table(spark, sf_dir, "events").select("event_id", "props")
    return load_records(parts, _pairs_of, "record_id string, label string, number long")


class _PricesByFolder:
    """Loads orders that Spark wrote as text, a folder for each priority, with pyarrow."""

    schema = f"{KEY} string, status string, price long"

    def __init__(self, path):
        self.path = path

    def plan(self, keys):
        system, root = fs.FileSystem.from_uri(self.path)
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.extension == "txt")

    def load(self, piece, keys, labels):
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(piece) as stream:
            for line in stream.read().decode().splitlines():
                key, status, price = line.split("\t")
                yield {KEY: key, "status": status, "price": int(price)}


@query(
    "load_source",
    """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders""",
)
def from_user_source(spark, sf_dir):
    path = scratch_path(spark, "prices")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))
    table(spark, sf_dir, "orders").select(line.alias("value"), "o_orderpriority").write.partitionBy("o_orderpriority").text(path)
    return load_source(spark, _PricesByFolder(re.sub("^file:/+", "file:///", path)), labels=["price"])
