"""Queries that measure each document: quality rules and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordflow.llm.host_rules import host_verdicts
from recordflow.llm.registry import query, table
from recordflow.llm.token_counts import count_tokens

# SQL for the words, measured over whole texts; the host rule follows the operator's formulas.
_HOST_SQL = r"""
WITH w AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT *, list_transform(range(1, greatest(len(ws) - 4, 0) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')) AS grams,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w
), r AS (
  SELECT *, map_from_entries(list_transform(list_filter(map_entries(list_histogram(grams)), lambda e: e.value > 1), lambda e: {'k': e.key, 'v': true})) AS twice FROM g
), m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(list_distinct(flatten(list_transform(list_filter(range(1, len(grams) + 1), lambda i: coalesce(twice[grams[i]], false)), lambda i: [i, i + 1, i + 2, i + 3, i + 4]))))::BIGINT AS n_repeat_words
  FROM r
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS failed FROM f GROUP BY source
), p AS (
  SELECT avg(failed / n) AS m, var_pop(failed / n) AS v, greatest(avg(n), 1.0) AS most FROM h
), q AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE most END, 1.0), most) AS weight FROM p
), b AS (
  SELECT h.source, (failed + q.m * q.weight) / (n + q.weight) > 0.5 AS bad FROM h CROSS JOIN q
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT b.bad AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""


@query("op9_host_rules", _HOST_SQL)
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_verdicts(table(spark, sf_dir, "documents"), keep=["doc_id"])


def vocabulary_path() -> str:
    """The default vocabulary: a file of public pieces installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), keep=["doc_id"])
