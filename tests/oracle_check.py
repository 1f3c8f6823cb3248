"""Compare every query with its SQL on one scale: ``python tests/oracle_check.py sf0.01 [name ...]``."""

from __future__ import annotations

import contextlib
import io
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


# Result types and their SQL names.
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}

# Operators that pair every row of one side with every row of the other.
CROSS_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences between a query and its SQL, and cross joins in its plan; empty when fine."""
    df = entry_module.queries()[name](spark, sf_dir)
    crossed = [x for x in CROSS_JOINS if x in plan_of(df)]
    if crossed:
        return [f"plan has {crossed}"]
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(row[c] for c in columns) for row in df.collect())))
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return []
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != columns:
        return [f"columns {columns} but SQL has {sorted(names)}"]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    other = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema if TYPES.get(f.dataType.simpleString()) != kinds[f.name]]
    if other:
        return [f"types differ: {other}"]
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(row[i] for i in order)) for row in rel.fetchall())
    if mine == theirs:
        return [] if mine else ["no rows"]
    only_mine, only_theirs = sorted(set(mine) - set(theirs))[:3], sorted(set(theirs) - set(mine))[:3]
    return [f"{len(mine)} rows but SQL has {len(theirs)}; only here {only_mine}; only SQL {only_theirs}"]


if __name__ == "__main__":
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle_connection(sf_dir), 0
    for name in sys.argv[2:] or sorted(entry_module.queries()):
        start = time.time()
        try:
            problems = compare(spark, con, name, sf_dir)
        except Exception as err:
            problems = [f"{type(err).__name__}: {str(err)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s {' '.join(problems)}", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))
