"""Measure every document, keep the good ones, annotate and export them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators.records import KEY, keyed_records
from recordflow.operators.sets import keep_ids, keep_where, set_step, set_value
from recordflow.operators.steps import Dependency, map_step
from recordflow.plans.registry import query, table, words
from recordflow.sources.results import export_results
from recordflow.storage import cut


def size_class(records, gate):
    """Reusable step: the class of whatever is bound to ``size``."""
    value = F.when(F.col("size") < 500, "short").when(F.col("size") < 2000, "mid").otherwise("long")
    return map_step(records, "Classify", run={"size_class": value, "n_words": F.col("size")}, gate=gate)


@query(
    "annotate_documents",
    r"""WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, doc_id, lang,
        CAST(len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents),
    s AS (SELECT count(*) AS n, sum(n_words) AS total FROM m),
    k AS (SELECT m.* FROM m, s WHERE n_words * 2 * n >= total AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
      AND lang = 'en')
    SELECT record_id, 'size_class' AS label, CASE WHEN n_words < 500 THEN 'short' WHEN n_words < 2000 THEN 'mid' ELSE 'long' END AS value FROM k
    UNION ALL SELECT record_id, 'n_words', CAST(n_words AS VARCHAR) FROM k""",
)
def annotate_documents(spark, sf_dir):
    documents = keyed_records(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"])
    measured = map_step(
        documents, "Measure", run={"n_words": F.size(words("text")).cast("long"), "n_chars": F.length("text").cast("long")}
    )
    # Written once without the texts: the set step and the rows after it share one pass over them.
    measured = cut(measured.drop("text"), "measured")
    quality = set_step(measured, {"n": F.count(F.lit(1)), "total": F.sum("Measure.n_words")})
    good = keyed_records(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", [])
    mean = set_value(quality)
    kept = keep_where(keep_ids(measured, good), F.col("Measure.n_words") * 2 * mean["n"] >= mean["total"])
    uses = Dependency(size_class, {"Measure": {"n_words": "size"}})
    annotated = map_step(
        kept, "Annotate",
        run={"size_class": F.col("Classify.size_class"), "n_words": F.col("Classify.n_words")},
        depends=[uses], condition=F.col("lang") == "en",
    )
    return export_results(annotated, "Annotate", ["size_class", "n_words"], "annotate", 3).select(KEY, "label", "value")
