import os
import random
import re

import pytest
from pyspark.sql import functions as F

from recordflow.functions import (
    data_files,
    duration_unit,
    duration_value,
    export_name,
    fill_template,
    glob_to_regex,
    is_true,
    prefix,
    scoped_name,
    split_data,
    split_flags,
    strip_suffix,
)


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("v")).first()["v"]


PATHS = ["/p/a.b.tar.gz", ".bashrc", "..a", "x.", "a..b", "no", "/d.x/no", "/d/.h.txt", "dir.d/", "a.fa"]


def test_prefix_of_awkward_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = [r["v"] for r in df.select(prefix("p").alias("v")).collect()]
    assert got == ["a.b.tar", ".bashrc", "..a", "x", "a.", "no", "no", ".h", "", "a"]


def test_prefix_and_export_name_match_python(spark):
    rng = random.Random(7)
    paths = ["".join(rng.choice("ab./") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for row in df.select("p", prefix("p").alias("x"), export_name("p", "S").alias("e")).collect():
        base, ext = os.path.splitext(os.path.basename(row["p"]))
        assert row["x"] == base, row
        assert row["e"] == f"{base}.S{ext}", row


def test_strip_suffix_takes_the_end_alone(spark):
    assert value(spark, strip_suffix("n", ".fa"), n="x.fa.fa") == "x.fa"
    assert value(spark, strip_suffix("n", ".fa"), n="x.fasta") == "x.fasta"


@pytest.mark.parametrize("text, flags, data", [("-a  -b ", ["-a", "-b"], ["-a", "", "-b", ""]), ("", [], [""])])
def test_splits(spark, text, flags, data):
    assert value(spark, split_flags("t"), t=text) == flags
    assert value(spark, split_data("t"), t=text) == data


def test_splits_of_null_and_colons(spark):
    assert value(spark, split_flags(F.lit(None).cast("string"))) == []
    assert value(spark, data_files("t"), t="a db:/x/y c:d:e") == ["a", "/x/y", "d"]


@pytest.mark.parametrize(
    "seconds, number, unit", [(60, 60, "s"), (61, 61 / 60, "m"), (3600, 60, "m"), (5400, 1.5, "h"), (86400, 24, "h"), (172800, 2, "d")]
)
def test_duration(spark, seconds, number, unit):
    assert value(spark, duration_unit("s"), s=seconds) == unit
    assert value(spark, duration_value("s"), s=seconds) == pytest.approx(number)


def test_small_functions(spark):
    assert value(spark, fill_template("{record_id}.x/{record_id}", "r"), r="s1") == "s1.x/s1"
    assert value(spark, scoped_name("s", "n"), s="root", n="A") == "A"
    assert value(spark, scoped_name("s", "n"), s="Owner", n="A") == "Owner.A"
    assert [value(spark, is_true("s"), s=s) for s in ("TRUE", "true", "1", "yes")] == [True, True, False, False]
    assert value(spark, is_true(F.lit(None).cast("string"))) is False


def test_glob_matches_like_the_shell(tmp_path):
    rng = random.Random(3)
    names = {"".join(rng.choice("ab.1-") for _ in range(rng.randint(1, 5))) for _ in range(300)} - {".", ".."}
    for name in names:
        (tmp_path / name).touch()
    import glob

    for pattern in ["*", "a*", "?b*", "*.a", ".*", "[ab]*", "[!a]?", "*[1-]", "a.b", "[", "a[b"]:
        found = {os.path.basename(p) for p in glob.glob(os.path.join(tmp_path, pattern))}
        mine = {n for n in names if re.fullmatch(glob_to_regex(pattern), n)}
        assert mine == found, pattern
