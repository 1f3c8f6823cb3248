"""Quality rules and token counts against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry_module
from recordflow.llm import textbytes as tb
from recordflow.llm.host_rules import host_verdicts
from recordflow.llm.token_counts import UNKNOWN_SCORE, WORD_MARK, TrieCounter, count_tokens, load_pieces
from recordflow.llm.text_queries import vocabulary_path
from tests.oracle_check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \n\t ", "one", "a b c d e " * 4, "x\ny\nx\n x\n\nx", "é # ü|%  end", "a" * 5000, "same line\nsame line\r\nsame line",
         "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w7 w8 w9 w10 w11 w12", "a b c d e " * 4]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("chunk_bytes", [1, 40, 1 << 20])
def test_spans_do_not_depend_on_chunks(chunk_bytes):
    found, per_text = [], {}
    for chunk in tb.chunks(pa.array(TEXTS), chunk_bytes):
        data = chunk.data.tobytes()
        spans = tb.words(chunk)
        for s, e, t, h in zip(spans.start, spans.end, spans.text, tb.word_hashes(chunk, spans), strict=True):
            found.append((chunk.first + t, data[s:e].decode(), h))
            per_text.setdefault(data[s:e], set()).add(h)
    assert [(t, w) for t, w, _ in found] == [(i, w) for i, x in enumerate(TEXTS) for w in WORD.findall(x or "")]
    assert all(len(h) == 1 for h in per_text.values()) and len({h for _, _, h in found}) == len(per_text)


def test_lines_of_each_text():
    for chunk in tb.chunks(pa.array(TEXTS)):
        data, rows = chunk.data.tobytes(), tb.lines(chunk)
        got = [(t, data[s:e].decode()) for s, e, t in zip(rows.start, rows.end, rows.text, strict=True)]
        assert got == [(i, x) for i, t in enumerate(TEXTS) for x in (t or "").split("\n")]


def test_measures_of_edge_texts(spark):
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    docs = docs.withColumnsRenamed({}).selectExpr("*", "'old' AS n_words", "1 AS kept")
    got = {r["doc_id"]: r for r in host_verdicts(docs, max_rate=1.0).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        want = brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_bad_hosts_lose_their_documents_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "bad", "x") for i in range(50)] + [(50, "bad", good)] + [(100 + i, "good", good) for i in range(60)]
    rows += [(200, "small", "x"), (201, "small", good), (300, None, good)] + [(400 + i, f"h{i}", good) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r["doc_id"]: r["kept"] for r in host_verdicts(docs).collect()}
    assert not kept[50] and kept[100] and kept[201] and kept[300] and not kept[200]
    assert len(kept) == len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert host_verdicts(docs).count() == 0
    assert count_tokens(docs, vocabulary_path()).count() == 0


def viterbi(pieces, word):
    marked, best = WORD_MARK + word, [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        s, n = best[end - 1]
        options = [(s + UNKNOWN_SCORE, -n - 0, n + len(marked[end - 1].encode()))]
        options += [(best[b][0] + pieces[marked[b:end]], 0, best[b][1] + 1) for b in range(end) if marked[b:end] in pieces]
        top = max(o[0] for o in options)
        best.append((top, min(o[2] for o in options if o[0] == top)))
    return best[-1][1]


def test_trie_counts_equal_plain_viterbi():
    pieces = load_pieces(vocabulary_path())
    words = ["the", "there", "therefore", "thé", "日本語", "x" * 300, "un", "unbelievable", "", "🎉🎉", "der", "dessen"]
    assert TrieCounter(pieces).count(words) == {w: viterbi(pieces, w) for w in words}
    rng = np.random.default_rng(7)
    small = {WORD_MARK: -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "aba": -2.5, WORD_MARK + "a": -1.5, "bb": -1.9}
    many = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(500)]
    assert TrieCounter(small).count(many) == {w: viterbi(small, w) for w in many}


def test_token_counts_of_documents(spark):
    pieces = load_pieces(vocabulary_path())
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in count_tokens(docs, vocabulary_path()).collect()}
    assert got == {i: (len(WORD.findall(t or "")), sum(viterbi(pieces, w) for w in WORD.findall(t or ""))) for i, t in enumerate(TEXTS)}


def test_host_rules_agree_with_sql(spark):
    assert compare(spark, oracle_connection(SF_DIR), "op9_host_rules", SF_DIR) == []


def test_token_counts_query(spark):
    pieces, seen = load_pieces(vocabulary_path()), {}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in entry_module.queries()["op10_token_counts"](spark, SF_DIR).collect():
        words = WORD.findall(docs.pop(r["doc_id"]))
        for w in words:
            if w not in seen:
                seen[w] = viterbi(pieces, w)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(seen[w] for w in words))
    assert not docs
