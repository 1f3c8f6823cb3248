"""Query of the periodic runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm.periodic_runs import find_runs
from recordflow.llm.registry import query, table


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the texts, picked by checksum, some words repeat to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    parts = words.withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    parts = parts.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    repeated = F.expr(
        "array_join(slice(concat(slice(words, 1, int(a)), flatten(array_repeat(slice(words, int(a) + 1, int(p)), int(1 + (n - a) DIV p)))), 1, int(n)), ' ')")
    return parts.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(table(spark, sf_dir, "documents")), keep=["doc_id"])
    best = F.expr("array_max(transform(runs, r -> struct(r.length / r.period AS e, -r.start AS s, -r.period AS p, r.length AS n)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n DIV -best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
