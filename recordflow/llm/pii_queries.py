"""Query of the surrogates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordflow.llm.pii import pseudonymize
from recordflow.llm.registry import query, table

# For these test tables; real runs pass their own secret.
TEST_KEY = "key of the test tables"


@query("op5_surrogates")
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, TEST_KEY, report=True)
