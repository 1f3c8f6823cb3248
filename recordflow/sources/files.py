"""File listings, and files grouped into records by their suffix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.functions.text import strip_suffix
from recordflow.operators.records import KEY
from recordflow.storage import write_once

# Default suffixes of each label.
DEFAULT_RULES: dict[tuple[str, ...], str] = {
    (".fna", ".fa", ".fasta", ".faa", ".fas"): "fasta",
    ("_1.fastq", "_1.fq", ".1.fastq", ".1.fq"): "fastq_1",
    ("_2.fastq", "_2.fq", ".2.fastq", ".2.fq"): "fastq_2",
    (".gff", ".gff3"): "gff3",
}


def list_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """File manifest ``(path, length, modificationTime)`` of a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(directory).select("path", "length", "modificationTime")


def suffix_labels(rules: Mapping[Sequence[str] | str, str]) -> dict[str, str]:
    """Flat ``{suffix: label}`` of rules whose keys are a suffix or several."""
    flat: dict[str, str] = {}
    for suffixes, label in rules.items():
        for suffix in [suffixes] if isinstance(suffixes, str) else suffixes:
            flat[suffix] = label
    return flat


def match_suffixes(manifest: DataFrame, rules: Mapping = DEFAULT_RULES, path: str = "path") -> DataFrame:
    """``(record_id, label, path)`` for each suffix a file name ends in; other files are dropped.

    Rules are part of the program, so matching is a row-local expression and not a join.
    """
    name = F.substring_index(F.col(path), "/", -1)
    matches = [
        F.when(F.endswith("name", F.lit(suffix)), F.struct(strip_suffix("name", suffix).alias(KEY), F.lit(label).alias("label")))
        for suffix, label in suffix_labels(rules).items()
    ]
    named = manifest.select(F.col(path).alias("path"), name.alias("name"))
    found = named.select("path", F.explode(F.array(*matches)).alias("m")).where(F.col("m").isNotNull())
    return found.select(F.col(f"m.{KEY}").alias(KEY), F.col("m.label").alias("label"), "path")


def files_to_records(manifest: DataFrame, rules: Mapping = DEFAULT_RULES, path: str = "path") -> DataFrame:
    """Record set with one path column per label; of two files for one, the greatest path wins."""
    labels = list(dict.fromkeys(suffix_labels(rules).values()))
    matched = match_suffixes(manifest, rules, path)
    return matched.groupBy(KEY).pivot("label", labels).agg(F.max("path"))


def stage_input(df: DataFrame, path: str) -> DataFrame:
    """Write a normalised copy of the input once; an existing whole copy is kept and read back."""
    spark = df.sparkSession
    write_once(spark, path, lambda side: df.write.parquet(side))
    return spark.read.parquet(path)
