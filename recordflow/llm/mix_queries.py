"""Query of the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordflow.llm.mixing import mix
from recordflow.llm.registry import query, table


@query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
