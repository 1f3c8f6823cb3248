"""Query of the URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordflow.llm.registry import query, table
from recordflow.llm.url_filter import SUSPECT_WORDS, judge_urls, suspect_hosts

# The rules of this query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_WORDS = ", ".join(f"'{w}'" for w in SUSPECT_WORDS)

_URL_SQL = rf"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), k(host, path, action) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)}
), f AS (
  SELECT u.page_id, u.host, u.path, max_by(k.host || k.path, length(k.host || k.path)) AS rule, max_by(k.action, length(k.host || k.path)) AS action
  FROM u LEFT JOIN k ON ('.' || u.host LIKE '%.' || k.host) AND starts_with(u.path, k.path) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(action,
  CASE WHEN list_has_any(string_split_regex(host, '[^a-z0-9]+'), [{_WORDS}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""


@query("op11_url_filter", _URL_SQL)
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(pages, rules, suspect_hosts(pages), keep=["page_id"]).drop("listed")
