"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordflow.llm.quality import classify, train
from recordflow.llm.registry import query, table


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
