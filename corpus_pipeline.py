"""From raw documents to a training mix, one operator of ``recordflow.llm`` for each stage.

Every stage is written as Parquet in the shared folder and read again by the next, so a lost executor costs
tasks of one stage. Stages before the last return the columns of ``documents``, extra ones included; an empty table
passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm.decontaminate import decontaminate
from recordflow.llm.mixing import mix
from recordflow.llm.ngram_join import keep_first
from recordflow.llm.pii import pseudonymize
from recordflow.llm.pii_queries import TEST_KEY
from recordflow.llm.quality import RESULTS, classify, train
from recordflow.storage import cut

# No SQL can train the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, unchanged.

    NULL and empty texts are scored like any other, repeated rows one by one, texts of any length whole; ties of the score
    do not matter, the threshold itself is accepted. Columns that are named like the classifier's results keep their own values.
    """
    aside = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in RESULTS}
    scored = classify(docs.withColumnsRenamed(aside), train(docs, _table(spark, sf_dir, "labels")))
    return scored.where(F.col("predicted") == 1).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id.

    NULL and empty texts are like nothing and stay, as do documents without an id; of repeated rows one stays.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, unchanged.

    NULL and empty texts and NULL ids stay; repeated rows are searched one by one, texts of any length whole.
    """
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their texts.

    NULL texts stay NULL; repeated rows get the same surrogates; all other columns stay as they are.
    """
    return pseudonymize(docs, TEST_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words it takes of each and how many copies these are, the last maybe in part.

    Documents without words are never taken. NULL is a source; repeated rows are documents of their own. Columns
    named like the results are replaced by them.
    """
    mixed = mix(docs)
    return mixed.where(F.col("taken") > 0).withColumn("copies", F.ceil(F.col("taken") / F.col("size")).cast("int"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
