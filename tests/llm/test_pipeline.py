"""The pipeline, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from recordflow.storage import cut
from tests.llm.test_ngram_join import brute

SF_DIR = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, tables = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF_DIR), name)
        tables[name] = docs
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    ids = {name: [r["doc_id"] for r in t.select("doc_id").collect()] for name, t in tables.items()}
    texts = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    assert all(len(set(x)) == len(x) for x in ids.values())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [i for i in texts if labels.get(i) == 1]
    assert sum(i in set(ids["quality"]) for i in good) >= 0.97 * len(good)
    assert {i for i, _, c in brute([(i, texts[i]) for i in ids["quality"]]) if i == c} == set(ids["near_duplicates"])
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert not [i for i in ids["decontamination"] if any(x in texts[i] for x in items)]
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {i for i in ids["near_duplicates"] if any(x in texts[i] for x in items)}
    assert set(ids["surrogates"]) == set(ids["decontamination"])
    mixed = tables["mixture"].collect()
    assert mixed and all(0 < r["taken"] <= r["copies"] * r["size"] <= 3 * r["size"] and r["taken"] > (r["copies"] - 1) * r["size"] for r in mixed)


def test_run_gives_the_last_stage(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "surrogates", "mixture"]
    assert corpus_pipeline.run(spark, SF_DIR).where("taken > 0").count() > 0


def test_stages_on_odd_rows(spark):
    """NULLs in any column, empty and long texts, repeated rows, an empty table, and columns named like results."""
    good = next(r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy(F.length("text").desc()).limit(40).collect() if r["lang"] == "en")["text"]
    other = "The harvest festival opened with music on the old square, and every bakery in the street sold bread until late in the evening. " * 3
    rows = [
        (1, good, "en", "a", 7.5, None), (1, good, "en", "a", 7.5, None), (2, other, None, None, None, 3), (3, None, "en", "a", 1.0, 1), (None, other + "x", "en", "b", 2.0, 2),
        (4, "", None, "b", 3.0, None), (5, "word " * 300_000, "en", "c", 4.0, 9), (6, other, "de", "b", 5.0, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, Size int")
    given = {(r[0], r[4], r[5]) for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name
        got = out.collect()
        if name == "mixture":
            assert {r["doc_id"] for r in got} == {1, 2, None, 5, 6} and len(got) == 6
            continue
        assert out.columns == docs.columns and {(r["doc_id"], r["score"], r["Size"]) for r in got} <= given
        if name == "near_duplicates":
            # Row 6 repeats the text of row 2.
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 3, 4, 5]
        elif name != "quality":
            assert len(got) == len(rows)
