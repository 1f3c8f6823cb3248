"""URL filters against plain loops, with lists in several blocks."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry_module
from recordflow.llm import url_filter
from recordflow.llm.url_filter import cascade, contains, judge_urls, passing, suspect_hosts
from tests.oracle_check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
RULE = "host string, path string, action string"


def brute(url, lists):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    for k, rules in enumerate(lists):
        found = []
        for h, p, a in rules:
            if h is not None and a in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
                found.append((len(h + (p or "")), h.count("."), a == "block", h + (p or "")))
        if found:
            _, _, blocks, key = max(found)
            return host, path, key if k == 0 else None, "block" if blocks else "allow", key if k == 1 else None
    return host, path, None, "allow", None


def test_query_agrees_with_its_sql(spark):
    assert compare(spark, oracle_connection(SF_DIR), "op11_url_filter", SF_DIR) == []
    assert "op11_url_filter" in entry_module.oracle_sql()


@pytest.mark.parametrize("block_keys", [4_000_000, 40])
def test_against_loops(spark, monkeypatch, block_keys):
    monkeypatch.setattr(url_filter, "BLOCK_KEYS", block_keys)
    rng = random.Random(block_keys)

    def host():
        return ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))

    def path():
        return "".join("/" + "".join(rng.choice("xyé") for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(0, 3)))

    urls = [rng.choice(["http", "https", ""]) + "://" + rng.choice([host(), host().upper()]) + path() + rng.choice(["", "?q=/x://", "#t", "?#"]) for _ in range(600)]
    urls += [None, "", "no scheme", "://", "a://b", "x://a.b?/x", "x://" + "a." * 3000 + "b/x", "http://a/" + "x" * 20000, "ftp://a..b/", "http://u:p@a.b:80/x"]
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)]
    own = [(host(), rng.choice([path(), None]), rng.choice(["allow", "block", "other", None])) for _ in range(150)] + [(None, "/", "block")]
    pages = spark.createDataFrame([(i, u, f"r{i}", i) for i, u in enumerate(urls)] + [(0, urls[0], "again", 7)], "page_id long, url string, rule string, best int")
    got = judge_urls(pages, spark.createDataFrame(rules, RULE), spark.createDataFrame(own, RULE))
    assert got.columns == ["page_id", "url", "best", "host", "path", "rule", "verdict", "listed"]
    rows = got.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == brute(r["url"], [rules, own])


def test_cascade_is_exact(spark):
    """More keys than bits tell apart: several levels, none wrong."""
    keys = spark.range(40_000).selectExpr("id", "xxhash64(id) AS a", "xxhash64(id, 3) AS b")
    yes, no = keys.where("id % 8 = 0").select("a", "b"), keys.where("id % 8 <> 0").select("a", "b")
    levels = cascade(yes, 5_000, lambda level0: passing(no, level0, 0))
    assert len(levels) > 2
    table = keys.toPandas()
    got = contains(levels, table["a"].to_numpy().view(np.uint64), table["b"].to_numpy().view(np.uint64))
    assert (got == (table["id"] % 8 == 0).to_numpy()).all()


def test_plan_judges_without_join_or_shuffle(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    plan = judge_urls(pages, spark.createDataFrame([("com", "/", "allow")], RULE), suspect_hosts(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], RULE)
    assert [tuple(r) for r in judge_urls(pages, none, none).collect()] == [(1, "http://a.b/c", "a.b", "/c", None, "allow", None)]
    assert judge_urls(pages.limit(0), spark.createDataFrame([("a.b", "/", "block")], RULE), none).count() == 0


def test_suspect_hosts(spark):
    pages = spark.createDataFrame([(u,) for u in ["http://cheap-pills.a/", "http://www.Casino.b", "http://seaside.c/", None, "http://x.y/casino"]], "url string")
    assert sorted(r["host"] for r in suspect_hosts(pages).collect()) == ["cheap-pills.a", "www.casino.b"]
