"""Periodic runs against brute force over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_module
from recordflow.llm.periodic_runs import Wavelet, find_runs, word_runs

SF_DIR = "/root/testdata/sf0.001"


def brute(words, min_length=6, min_exponent=4):
    """For each period the maximal stretches that keep it; the smallest period of a stretch stays."""
    n, best = len(words), {}
    for q in range(n // min_exponent, 0, -1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                best[i, j + q] = q
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sample(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        root = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 12))]
        out += (root * rng.randint(1, 9))[: rng.randint(1, 90)]
        if rng.random() < 0.3:
            out = (out * rng.randint(1, 6))[:600]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_words_against_brute_force(seed):
    rng = random.Random(seed)
    texts = [sample(rng) for _ in range(40)] + [[], ["x"] * 500, list("ab") * 200, list("aab" * 30 + "a" * 40 + "aab" * 30)]
    code = {w: i for i, w in enumerate("abcdefghx")}
    ids = np.array([code[w] for t in texts for w in t], dtype=np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0] + [len(t) for t in texts])
    for min_length, min_exponent in [(6, 4), (1, 3), (12, 5)]:
        rows = word_runs(ids, text, min_length, min_exponent)
        got = [(int(text[s]), int(s - first[text[s]]), int(n), int(q)) for s, n, q in rows]
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t, min_length, min_exponent)]


def test_wavelet_against_sorting():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = Wavelet(values)
    low = rng.integers(0, 300, 2000)
    high = np.minimum(low + rng.integers(1, 80, 2000), 300)
    x = rng.integers(0, 700, 2000)
    want = [min((v for v in values[a:b] if v >= y), default=300) for a, b, y in zip(low, high, x, strict=True)]
    assert tree.successor(low, high, x).tolist() == want


def test_texts_nulls_and_clashing_names(spark):
    rng = random.Random(5)
    texts = [" ".join(sample(rng)) for _ in range(30)] + [None, "", " \t\n", "é é\né é\té é é", "a  b" * 3, "x " * 50_000 + "y " * 9, "\x00 " * 8, "a a " * 7]
    docs = spark.createDataFrame([(i, t, 5, "r") for i, t in enumerate(texts)] + [(0, texts[0], 5, "r")], "doc_id long, text string, runs int, extra string")
    got = find_runs(docs)
    assert got.columns == ["doc_id", "extra", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        want = brute(words) if len(words) < 10_000 else [(0, 50_000, 1), (50_000, 9, 1)]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want)
    assert find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(docs, min_exponent=2)


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in entry_module.queries()["op12_periodic_runs"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    periodic = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3_000 and h % 10:
            continue  # too slow for brute force
        runs = brute(words)
        r = got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        want = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        periodic += bool(runs)
    assert periodic > 5
