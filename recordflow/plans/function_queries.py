"""Column functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions import (
    data_files,
    duration_unit,
    duration_value,
    export_name,
    fill_template,
    is_true,
    prefix,
    scoped_name,
    split_data,
    split_flags,
    strip_suffix,
)
from recordflow.plans.registry import query, table


def _page_paths(spark, sf_dir):
    """Each page's address and file names of its number that put dots at awkward places."""
    paths = F.array(
        "url", F.concat(F.lit("/p/"), "page_id", F.lit(".b.tar.gz")), F.concat(F.lit("."), "page_id"),
        F.concat(F.lit(".."), "page_id"), F.concat("page_id", F.lit(".")), F.concat("page_id", F.lit("..b")),
        F.concat(F.lit("/d.x/"), "page_id"), F.concat(F.lit("/d/.h"), "page_id", F.lit(".txt")), F.concat("page_id", F.lit(".d/")),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(paths).alias("i", "path"))


_PATHS = r"""p AS (SELECT page_id, unnest([url, concat('/p/', page_id, '.b.tar.gz'), concat('.', page_id), concat('..', page_id), concat(page_id, '.'),
    concat(page_id, '..b'), concat('/d.x/', page_id), concat('/d/.h', page_id, '.txt'), concat(page_id, '.d/')]) AS path FROM pages),
  b AS (SELECT page_id, path, string_split(path, '/')[-1] AS base FROM p),
  n AS (SELECT page_id, path, base, regexp_replace(base, '^(\.*[^.].*)\.[^.]*$', '\1') AS prefix FROM b)"""


@query("fn_prefix", "WITH " + _PATHS + " SELECT page_id, path, prefix FROM n")
def prefixes(spark, sf_dir):
    return _page_paths(spark, sf_dir).select("page_id", "path", prefix("path").alias("prefix"))


@query(
    "fn_export_name",
    "WITH " + _PATHS + " SELECT page_id, path, concat(prefix, '.Step', substr(base, length(prefix) + 1)) AS exported FROM n",
)
def export_names(spark, sf_dir):
    return _page_paths(spark, sf_dir).select("page_id", "path", export_name("path", "Step").alias("exported"))


@query(
    "fn_strip_suffix",
    """SELECT p_partkey, CASE WHEN ends_with(p_name, ' ring') THEN left(p_name, length(p_name) - 5) ELSE p_name END AS plain,
      concat(p_partkey, '.fa') AS repeated FROM part""",
)
def stripped(spark, sf_dir):
    repeated = F.concat("p_partkey", F.lit(".fa.fa"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", strip_suffix("p_name", " ring").alias("plain"), strip_suffix(repeated, ".fa").alias("repeated")
    )


@query(
    "fn_split_flags",
    """SELECT doc_id, CAST(len(f) AS BIGINT) AS n_tokens, md5(array_to_string(f, '|')) AS digest
    FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS f FROM documents)""",
)
def flags(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", split_flags("text").alias("f"))
    return tokens.select("doc_id", F.size("f").cast("long").alias("n_tokens"), F.md5(F.array_join("f", "|")).alias("digest"))


@query(
    "fn_split_data",
    """SELECT event_id, array_to_string(string_split(props, ' '), '|') AS data,
      array_to_string(list_transform(string_split(props, ' '), lambda x: CASE WHEN contains(x, ':') THEN split_part(x, ':', 2) ELSE x END), '|') AS files
    FROM events""",
)
def data(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(split_data("props"), "|").alias("data"), F.array_join(data_files("props"), "|").alias("files")
    )


@query(
    "fn_duration",
    """WITH s AS (SELECT event_id, CAST(floor(value * value) AS BIGINT) AS seconds FROM events)
    SELECT event_id, CASE WHEN seconds > 86400 THEN 'd' WHEN seconds > 3600 THEN 'h' WHEN seconds > 60 THEN 'm' ELSE 's' END AS unit,
      CAST(floor(1000 * CASE WHEN seconds > 86400 THEN seconds / 86400 WHEN seconds > 3600 THEN seconds / 3600
        WHEN seconds > 60 THEN seconds / 60 ELSE seconds END) AS BIGINT) AS thousandths FROM s""",
)
def durations(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * F.col("value")).alias("seconds"))
    thousandths = F.floor(F.lit(1000) * duration_value("seconds"))
    return spans.select("event_id", duration_unit("seconds").alias("unit"), thousandths.alias("thousandths"))


@query(
    "fn_scoped_name",
    """SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_name ELSE concat(c_mktsegment, '.', c_name) END AS full_name FROM customer""",
)
def scoped(spark, sf_dir):
    scope = F.when(F.col("c_nationkey") < 5, "root").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", scoped_name(scope, F.col("c_name")).alias("full_name"))


@query(
    "fn_is_true",
    "SELECT doc_id, quality = 1 OR toxic = 1 AS skipped FROM labels",
)
def truth(spark, sf_dir):
    setting = F.when(F.col("quality") == 1, "True").when(F.col("toxic") == 1, "tRUE").when(F.col("doc_id") > 100, "1")
    return table(spark, sf_dir, "labels").select("doc_id", is_true(setting).alias("skipped"))


@query(
    "fn_fill_template",
    "SELECT c_custkey, concat(c_name, '/', c_name, '.tmp') AS path FROM customer",
)
def filled(spark, sf_dir):
    path = fill_template("{record_id}/{record_id}.tmp", "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
