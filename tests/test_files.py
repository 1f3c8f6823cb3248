import random

import pytest
from pyspark.sql import functions as F

from recordflow.operators.checks import (
    MissingExport,
    MissingOutput,
    check_exports,
    check_outputs,
    drop_temp,
    mark_complete,
    missing_outputs,
    split_complete,
)
from recordflow.operators.records import MissingLabel
from recordflow.operators.sets import rollup_content
from recordflow.operators.steps import map_step
from recordflow.sources.files import files_to_records, list_files, stage_input
from recordflow.sources.sequences import fasta_lines, fastq_lines, read_fasta, read_fastq, read_gff3, read_label, write_lines
from tests.conftest import rows


def _names(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_files_of_a_folder_become_records(spark, tmp_path):
    for name in ["genome1.fna", "genome1.gff3", "SRR1234.1.fq", "SRR1234.2.fq", "notes.txt"]:
        (tmp_path / name).write_text("x\n")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "deep.fna").write_text("x\n")
    manifest = list_files(spark, str(tmp_path))
    assert manifest.columns == ["path", "length", "modificationTime"]
    assert manifest.count() == 5
    records = files_to_records(manifest)
    assert records.columns == ["record_id", "fasta", "fastq_1", "fastq_2", "gff3"]
    present = [F.col(c).isNotNull() for c in records.columns[1:]]
    assert rows(records.select("record_id", *present)) == [
        ("SRR1234", False, True, True, False), ("genome1", True, False, False, True)
    ]


def test_several_suffixes_and_repeats(spark):
    manifest = _names(spark, "/a/x.fa", "/b/x.fa", "/a/x.fa.fa", "/a/y_1.fq")
    got = rows(files_to_records(manifest, {(".fa", ".fna"): "fasta", "_1.fq": "mate", ".fq": "any"}))
    assert got == sorted(
        [("x", "/b/x.fa", None, None), ("x.fa", "/a/x.fa.fa", None, None), ("y", None, "/a/y_1.fq", None), ("y_1", None, None, "/a/y_1.fq")],
        key=repr,
    )


def test_fasta(spark, tmp_path):
    path = tmp_path / "sample.fasta"
    path.write_text(">sample\nACTG\n")
    content = read_fasta(spark, str(path)).withColumnRenamed("id", "record_id")
    assert rows(rollup_content(content)) == [("sample", 1, 4)]
    path.write_text(">a desc > more >\r\nAC TG\r\nAC\r\n\r\n>b\n>c\nT")
    assert rows(read_fasta(spark, str(path)), "id", "seq") == [("a", "ACTGAC"), ("b", ""), ("c", "T")]
    path.write_text("")
    assert read_fasta(spark, str(path)).count() == 0


FASTQ = "@read.7\n" + "ACGTN" * 12 + "\n+\n" + "*+%>@I" * 10 + "\n"


def test_fastq(spark, tmp_path):
    path = tmp_path / "sample.fastq"
    path.write_text(FASTQ * 3)
    got = read_fastq(spark, str(path))
    assert rows(got, "id", F.length("seq"), F.length("qual")) == [("read.7", 60, 60)] * 3
    assert files_to_records(_names(spark, str(path))).count() == 0
    path.write_text("")
    assert read_fastq(spark, str(path)).count() == 0


@pytest.mark.parametrize("ending, newline", [("\n", "\n"), ("", "\n"), ("\r\n", "\r\n")])
@pytest.mark.parametrize("split_bytes", [64, 1000, 1 << 20])
def test_fastq_quality_may_begin_with_the_record_mark(spark, tmp_path, split_bytes, ending, newline):
    """Any quality text and any split of the files gives every record once."""
    rng = random.Random(split_bytes)
    expected = []
    for name in ("one.fastq", "two.fastq"):
        lines = []
        for i in range(150):
            n = rng.choice([0, 1, 1, 2, 5, 9])
            seq = "".join(rng.choice("ACGT") for _ in range(n))
            qual = "".join(rng.choice("@@+I") for _ in range(n))
            lines += [f"@r{i} of {name}", seq, "+", qual]
            expected.append((f"r{i}", seq, qual))
        (tmp_path / name).write_bytes((newline.join(lines) + ending).encode())
    conf = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert rows(read_fastq(spark, str(tmp_path)), "id", "seq", "qual") == sorted(expected, key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text", ["@a\nAC\n+\nI\n", "@a\nAC\nGT\n+\nIIII\n", "@a\nAC\n", "@a\nAC\n+\n", "AC\n"])
def test_broken_fastq_fails(spark, tmp_path, text):
    (tmp_path / "x.fastq").write_text("@ok\nA\n+\nI\n" + text)
    with pytest.raises(Exception, match="four-line FASTQ"):
        read_fastq(spark, str(tmp_path)).collect()


def test_written_sequences_read_back(spark, tmp_path):
    seqs = [(f"s{i}", "ACGT" * i, "@+I>" * i) for i in range(40)]
    df = spark.createDataFrame(seqs, "id string, seq string, qual string")
    write_lines(fasta_lines(df), str(tmp_path / "a"))
    write_lines(fastq_lines(df), str(tmp_path / "q"))
    assert rows(read_fasta(spark, str(tmp_path / "a")), "id", "seq") == sorted((i, s) for i, s, _ in seqs)
    assert rows(read_fastq(spark, str(tmp_path / "q")), "id", "seq", "qual") == sorted(seqs)
    text = (line for p in (tmp_path / "a").glob("part-*") for line in p.read_text().splitlines())
    assert max(map(len, text)) == 60


def test_contents_of_a_folder_by_label(spark, tmp_path):
    (tmp_path / "sample.fasta").write_text(">sample\nACTG\n")
    (tmp_path / "a b.fa").write_text(">x\nAC\n>y\nG\n")
    (tmp_path / "sample.gff3").write_text("free text\n")
    (tmp_path / "s_1.fq").write_text("@r\nAC\n+\nII\n")
    (tmp_path / "s_2.fq").write_text("@r\nGG\n+\n@@\n")
    assert rows(rollup_content(read_label(spark, str(tmp_path), "fasta"))) == [("a b", 2, 3), ("sample", 1, 4)]
    assert rows(read_label(spark, str(tmp_path), "gff3"), "record_id", "line", "malformed") == [("sample", "free text", True)]
    assert rows(read_label(spark, str(tmp_path), "fastq_2"), "record_id", "id", "seq", "qual") == [("s", "r", "GG", "@@")]
    with pytest.raises(ValueError):
        read_label(spark, str(tmp_path), "unknown")


def test_gff3_keeps_every_line(spark, tmp_path):
    (tmp_path / "x.gff3").write_text("##gff-version 3\nthis is not a feature\nchr1\t.\tgene\t1\t9\t.\t+\t.\tID=g1\n\n")
    got = read_gff3(spark, str(tmp_path))
    assert rows(got.groupBy("malformed").count()) == [(False, 3), (True, 1)]
    assert rows(got.where("type = 'gene'"), "seqid", "end", "attributes") == [("chr1", "9", "ID=g1")]


def test_staged_copy_is_kept(spark, ids10, tmp_path):
    path = str(tmp_path / "staged")
    assert stage_input(ids10, path).count() == 10
    assert stage_input(ids10.where("record_id = '1'"), path).count() == 10


@pytest.fixture
def outputs(spark):
    return spark.createDataFrame(
        [("all", "a1", "a2"), ("half", "h1", "h2"), ("none", "n1", "n2"), ("one", "a1", None), ("nopath", None, None)],
        "record_id string, x string, y string",
    )


def test_resume_needs_a_path_and_all_of_them(spark, outputs):
    done, todo = split_complete(outputs, _names(spark, "a1", "a2", "a2", "h1"), ["x", "y"])
    assert rows(done, "record_id") == [("all",), ("one",)]
    assert rows(todo, "record_id") == [("half",), ("none",), ("nopath",)]


def test_complete_records_count_as_run_without_running(spark, outputs):
    marked = mark_complete(outputs, _names(spark, "a1", "a2"), ["x", "y"])
    assert rows(marked, "record_id", "complete") == [
        ("all", True), ("half", False), ("none", False), ("nopath", False), ("one", True)
    ]
    ran_on = F.when(F.col("complete"), F.raise_error("ran again").cast("string")).otherwise(F.col("record_id"))
    stepped = map_step(marked, "S", declare={"x": F.col("x")}, run={"r": ran_on}, complete=F.col("complete"))
    assert stepped.where("S_ran").count() == 5
    assert rows(stepped.where("complete"), "S.x", "S.r") == [("a1", None), ("a1", None)]


def test_missing_outputs(spark, outputs):
    manifest = _names(spark, "a1", "a2", "h1")
    assert rows(missing_outputs(outputs, "S", ["x", "y"], manifest)) == [
        ("half", "S", "y", "h2"), ("none", "S", "x", "n1"), ("none", "S", "y", "n2")
    ]
    with pytest.raises(MissingOutput):
        check_outputs(outputs, "S", ["x", "y"], manifest)
    assert check_outputs(outputs, "S", {"x": F.lit("a1")}, manifest).count() == 5


def test_missing_exports(ids10):
    stepped = map_step(
        ids10, "S", run={"x": F.when(F.col("record_id") != "3", 1)}, condition=F.col("record_id") != "4"
    )
    with pytest.raises(MissingExport):
        check_exports(stepped, "S", ["x"])
    assert check_exports(stepped.where("record_id <> '3'"), "S", ["x"]).count() == 9
    with pytest.raises(MissingLabel):
        check_exports(stepped, "S", ["y"])
    with pytest.raises(TypeError):
        check_exports(stepped, "S", "x")


@pytest.mark.parametrize(("glob", "gone", "kept"), [
    ("run?.log", ["run1.log", "runé.log"], ["run.log", "run12.log", "a/run1.log"]),
    ("shards/[!0-4]-*", ["shards/7-", "shards/x-y.z", "shards/7-a/deep/file"], ["shards/3-a", "shards/77-a", "7-a"]),
    ("{record_id}/*/part-[ab]", ["k.1/x/part-a", "k.1/yy/part-b"], ["k.1/part-a", "kx1/x/part-a", "k.1/x/y/part-a", "k.1/x/part-c"]),
    ("at-{record_id}-end-{record_id}", ["at-k.1-end-k.1"], ["at-k.1-end-k.2", "at-k.1-end-k.1x"]),
])
def test_globs_of_a_clean_up(spark, glob, gone, kept):
    manifest = spark.createDataFrame([("k.1", p) for p in gone + kept], "record_id string, path string")
    assert rows(drop_temp(manifest, [glob, "never/*"]), "path") == sorted((p,) for p in kept)


def test_clean_up_of_an_id_with_regex_characters(spark):
    odd = r"a\Eb.+"
    manifest = spark.createDataFrame([(odd, odd + ".tmp"), (odd, "aEb.+.tmp")], "record_id string, path string")
    assert rows(drop_temp(manifest, ["{record_id}*"])) == [(odd, "aEb.+.tmp")]
