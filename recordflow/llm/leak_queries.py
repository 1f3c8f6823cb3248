"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm.decontaminate import find_leaks
from recordflow.llm.registry import query, table


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items they hold."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_join(F.transform("matches", lambda m: m["item_id"].cast("string")), ",")
    return found.where(F.size("matches") > 0).select("doc_id", items.alias("items"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("least_edits"))
