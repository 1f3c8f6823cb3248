"""The FASTQ source: byte ranges of any size give every record once, in one scan."""

import gzip
import io
import random
from collections import Counter

import pytest

from recordflow.sources.fastq import FastqReader, expand_braces, first_record
from recordflow.sources.sequences import byte_size, read_fastq
from tests.conftest import rows
from tests.oracle_check import plan_of


def reads(seed, n, alphabet="ACGT", marks="@+I"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 1, 2, 5, 30])
        out.append((f"r{i}", "".join(rng.choice(alphabet) for _ in range(size)), "".join(rng.choice(marks) for _ in range(size))))
    return out


def text_of(records, newline="\n", ending="\n"):
    return newline.join(line for name, seq, qual in records for line in (f"@{name} of x", seq, "+", qual)) + ending


def read_pieces(path, split):
    reader = FastqReader({"paths": f'["{path}"]', "split": str(split)})
    found = [tuple(row.values())[1:] for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    return found, len(reader.partitions())


@pytest.mark.parametrize("split", [1, 37, 64, 100, 511, 4097])
@pytest.mark.parametrize(("alphabet", "marks"), [("ACGT", "@+I"), ("@+A", "@+")])
def test_ranges_of_any_size(tmp_path, split, alphabet, marks):
    """Also where sequences begin with the marks, so that lines must be counted from the start."""
    for newline, ending in (("\n", "\n"), ("\n", ""), ("\r\n", "\r\n")):
        want = reads(split, 80, alphabet, marks)
        path = tmp_path / "x.fastq"
        path.write_bytes(text_of(want, newline, ending).encode())
        got, n = read_pieces(path, split)
        assert Counter(got) == Counter(want) and (n > 1) == (path.stat().st_size > split)


@pytest.mark.parametrize("spoil", ["drop", "double", "cut"])
def test_a_spoilt_line_fails_for_every_split(tmp_path, spoil):
    lines = text_of(reads(3, 40, marks="I@")).encode().splitlines(keepends=True)
    path = tmp_path / "x.fastq"
    for place in (6, 77, 94, 150):
        kept = lines[:place] + {"drop": [], "double": [lines[place]] * 2, "cut": [lines[place][:-2] + b"xy\n"]}[spoil] + lines[place + 1 :]
        if spoil == "cut" and place % 4 in (0, 2):
            continue  # titles and plus lines may hold anything
        path.write_bytes(b"".join(kept))
        for split in (10, 63, 200, 10_000):
            with pytest.raises(ValueError, match="four-line FASTQ"):
                read_pieces(path, split)


def test_counting_from_the_start_where_all_ways_fit():
    data = b"@\n@\n+\n+\n" * 40
    starts = {first_record(io.BufferedReader(io.BytesIO(data)), k) for k in range(1, 200)}
    assert all(s % 8 == 0 for s in starts)


def test_one_scan_of_folders_lists_and_compressed_files(spark, tmp_path):
    one, two = reads(1, 30), reads(2, 30)
    (tmp_path / "a b+c.fastq").write_text(text_of(one))
    (tmp_path / "z.fastq.gz").write_bytes(gzip.compress(text_of(two).encode()))
    (tmp_path / "_hidden.fastq").write_text("no record")
    (tmp_path / "other.txt").write_text("no record")
    got = read_fastq(spark, str(tmp_path), glob="*{.fastq,.fastq.gz}", split_bytes=97)
    plan = plan_of(got)
    assert plan.count("Scan") == 1 and "Exchange" not in plan and "Window" not in plan
    assert rows(got, "id", "seq", "qual") == sorted(one + two, key=repr)
    listed = read_fastq(spark, [str(tmp_path / "a b+c.fastq"), f"file:{tmp_path}/z.fastq.gz"])
    assert listed.count() == 60 and sorted(r["file"].rpartition("/")[2] for r in listed.select("file").distinct().collect()) == ["a%20b%2Bc.fastq", "z.fastq.gz"]
    assert read_fastq(spark, str(tmp_path), glob="*.none").count() == 0
    with pytest.raises(Exception, match="missing"):
        read_fastq(spark, str(tmp_path / "missing")).collect()


def test_sizes_and_globs():
    assert [byte_size(x) for x in ("64", "64b", "4k", "128MB", "1 GiB")] == [64, 64, 4096, 128 << 20, 1 << 30]
    assert expand_braces("*{a,b}{1,2}") == ["*a1", "*a2", "*b1", "*b2"]
