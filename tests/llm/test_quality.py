"""The quality classifier: held-out accuracy, folds, edge cases."""

import zlib

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry_module
from recordflow.llm.boosting import fit
from recordflow.llm.quality import N_FEATURES, classify, features, train

SF_DIR = "/root/testdata/sf0.01"


def test_flat_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    model = fit(x[:3000], y[:3000], trees=40)
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_one_class_or_no_rows_give_a_constant():
    x = np.zeros((5, 2))
    assert np.allclose(fit(x, np.ones(5)).scores(x), 6 / 7)
    assert np.allclose(fit(x[:0], np.zeros(0)).scores(x), 0.5)


def test_features_are_finite_for_any_text():
    x = features(pa.array(["", None, " \n", "a", "x " * 100000, "é" * 999, "||||", "A! B!"]))
    assert x.shape == (8, N_FEATURES) and np.isfinite(x).all()


def test_held_out_rows_are_classified(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = entry_module.queries()["op2_quality"](spark, SF_DIR).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    test = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in test]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rest = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    a, b = (sorted(map(tuple, classify(docs, train(docs, x), ["doc_id"]).collect())) for x in (labels, rest))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, "", 1), (None, "x", 2), (3, None, 3), (1, "y", 4)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = classify(docs, train(docs, none)).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert classify(docs.limit(0), train(docs, none)).count() == 0
