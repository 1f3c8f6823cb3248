"""Sequence files as DataFrames. All readers split large files between tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.functions.text import strip_suffix
from recordflow.operators.records import KEY
from recordflow.sources.fastq import FastqSource
from recordflow.sources.files import DEFAULT_RULES, suffix_labels
from recordflow.storage import write_once

# The nine columns of a GFF3 line and the line width of a FASTA body.
GFF3_COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
FASTA_WIDTH = 60

Paths = str | Sequence[str]


def _first_token(title: Column) -> Column:
    return F.regexp_extract(title, r"^\s*(\S*)", 1)


def _lines(spark: SparkSession, paths: Paths, glob: str | None, separator: str | None = None) -> DataFrame:
    reader = spark.read
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if separator is not None:
        reader = reader.option("lineSep", separator)
    return reader.text(paths)


def read_fasta(spark: SparkSession, paths: Paths, glob: str | None = None) -> DataFrame:
    """``(file, id, seq)``: descriptions are dropped and body lines joined.

    A record starts at ``>`` after a line break, which is the reader's separator, so a ``>``
    inside a description is harmless and no ordering is needed.
    """
    chunks = _lines(spark, paths, glob, "\n>")
    record = F.regexp_replace("value", r"^\s*>", "")
    title = F.substring_index(record, "\n", 1)
    seq = F.substr(record, F.length(title) + 1)
    for blank in ("\n", "\r", " ", "\t"):
        seq = F.replace(seq, F.lit(blank), F.lit(""))
    return chunks.where(~F.col("value").rlike(r"^\s*>?\s*$")).select(
        F.col("_metadata.file_path").alias("file"), _first_token(title).alias("id"), seq.alias("seq")
    )


def read_fastq(spark: SparkSession, paths: Paths, glob: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """``(file, id, seq, qual)`` of four-line FASTQ records; anything else fails.

    One pass: each task reads a byte range of at most ``split_bytes`` (the session's file split size) and the
    end of its last record, see :mod:`recordflow.sources.fastq`. Compressed files are read whole, one for each task.
    """
    spark.dataSource.register(FastqSource)
    size = split_bytes or byte_size(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    options = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "split": str(size)}
    return spark.read.format("fastq").options(**options, **({} if glob is None else {"glob": glob})).load()


def byte_size(setting: str) -> int:
    """Bytes of a setting such as ``128MB``, ``64k`` or ``4096``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def read_gff3(spark: SparkSession, paths: Paths, glob: str | None = None) -> DataFrame:
    """Every line as it is, its nine columns where it has them, and a ``malformed`` flag.

    Comment and blank lines are neither split nor malformed.
    """
    fields = F.split("value", "\t", -1)
    comment = F.startswith(F.col("value"), F.lit("#")) | (F.trim("value") == "")
    is_feature = ~comment & (F.size(fields) == len(GFF3_COLUMNS))
    columns = [F.when(is_feature, fields[i]).alias(name) for i, name in enumerate(GFF3_COLUMNS)]
    return _lines(spark, paths, glob).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), *columns,
        (~comment & ~is_feature).alias("malformed"),
    )


# Reader of each default label.
READERS: dict[str, Callable[..., DataFrame]] = {
    "fasta": read_fasta, "fastq_1": read_fastq, "fastq_2": read_fastq, "gff3": read_gff3,
}


def read_label(
    spark: SparkSession, directory: str, label: str, rules: Mapping = DEFAULT_RULES, reader: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """Contents of the files of one label in a folder, with the ``record_id`` of each file.

    The label's suffixes become the scan's file filter, so no list of paths is gathered.
    """
    suffixes = [suffix for suffix, name in suffix_labels(rules).items() if name == label]
    if not suffixes:
        raise ValueError(f"no rule for label {label!r}")
    content = (reader or READERS[label])(spark, directory, glob="*{" + ",".join(suffixes) + "}")
    # Spark encodes file names, and a plus sign in one is no blank.
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    record_id = F.lit(None).cast("string")
    for suffix in suffixes:
        record_id = F.when(F.endswith(name, F.lit(suffix)), strip_suffix(name, suffix)).otherwise(record_id)
    return content.select(record_id.alias(KEY), "*")


def fasta_lines(records: DataFrame, id_col: str = "id", seq_col: str = "seq", width: int = FASTA_WIDTH) -> DataFrame:
    """One text value per record, with its body wrapped, ready for ``write.text``."""
    body = F.regexp_replace(seq_col, f"(.{{{width}}})(?=.)", "$1\n")
    return records.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), body).alias("value"))


def fastq_lines(records: DataFrame, id_col: str = "id", seq_col: str = "seq", qual_col: str = "qual") -> DataFrame:
    """One four-line text value per record, ready for ``write.text``."""
    return records.select(
        F.concat(F.lit("@"), F.col(id_col), F.lit("\n"), F.col(seq_col), F.lit("\n+\n"), F.col(qual_col)).alias("value")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Write text values once; an existing whole copy is kept."""
    write_once(lines.sparkSession, path, lambda side: lines.write.text(side))
