"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordflow.llm.licenses import scan
from recordflow.llm.registry import query, table


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
