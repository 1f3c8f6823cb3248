"""WARC archives: a reader as a Python data source, and a writer by Spark's own text sink.

The reader plans partitions of whole archive files by their sizes, parses each record's header first and
skips the block of a record that the record type or a header predicate does not want. The
payload is decoded only if the ``payload`` column is asked for (option ``payload``, true by default).
Predicates come from the options ``types`` and ``header.<Name>``, or from filters on the columns where Spark
pushes them down (``spark.sql.python.filterPushdown.enabled``). Files are read through the file system of
their URI, so archives may be anywhere that workers reach by one.

The writer makes one record of each row. Records with equal payloads: that with the least id is a
``response``, the others are ``revisit`` records that refer to it and hold no payload, if the payload
has at least ``min_bytes`` bytes. Groups are found by digest, added up before the shuffle.

NULL payloads count as empty. Rows without an id sort last, so they refer to another row where one has their
payload. Rows that repeat id and payload are alike and all are what the first is. Control characters and
blanks in an address become ``%20``. An empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from recordflow.storage import broadcast_if_small, cut, scratch_path

SPLIT_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
# Alphabet of base 32, revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Column and the header it is read from.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long"


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(0)
        self.paths = paths


def parse_headers(stream: io.BufferedIOBase, where: str) -> dict[str, str] | None:
    """Header of the next record, names in lower case; NULL at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins here: {where}: {line[:60]!r}")
    headers: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError(f"broken record header: {where}: {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    return headers


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        types = [t.strip() for t in options.get("types", "").split(",") if t.strip()]
        self.wanted: list[tuple[str, frozenset[str]]] = [("warc-type", frozenset(types))] if types else []
        self.wanted += [(k[7:].lower(), frozenset([v])) for k, v in options.items() if k.lower().startswith("header.")]

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        groups: list[list[str]] = []
        room = 0
        for path, size in files:
            if not groups or size > room:
                groups.append([])
                room = SPLIT_BYTES
            groups[-1].append(path)
            room -= size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            for row in self._records(system, path):
                rows.append(row)
                size += len(row[-1] or b"") + 500
                if size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(HEADERS) + [pa.int64()] + [pa.binary()] * self.with_payload
        names = [*HEADERS, "payload_bytes", *["payload"] * self.with_payload]
        columns = list(zip(*rows, strict=True)) if rows else [()] * (len(kinds) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    def _records(self, system: fs.FileSystem, path: str) -> Iterator[tuple]:
        with system.open_input_file(path) as raw:
            zipped = path.endswith(".gz")
            stream = gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw, 1 << 20)
            number = 0
            while (headers := parse_headers(stream, f"{path}, record {number}")) is not None:
                number += 1
                length = int(headers["content-length"])
                if any(headers.get(name) not in values for name, values in self.wanted):
                    self._skip(stream, length)
                    continue
                yield self._row(stream, headers, length, f"{path}, record {number}")

    @staticmethod
    def _skip(stream: io.BufferedIOBase, length: int) -> None:
        stream.seek(length, io.SEEK_CUR)

    def _row(self, stream: io.BufferedIOBase, headers: dict[str, str], length: int, where: str) -> tuple:
        read, size, payload = 0, length, None
        http = headers.get("content-type", "").startswith("application/http")
        if http:
            size = 0
            while read < length:
                line = stream.readline()
                read += len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
                name, _, value = line.decode("latin-1").partition(":")
                if name.strip().lower() == "content-length":
                    size = int(value)
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        revisit = headers.get("warc-type") == "revisit"
        if (self.with_payload or self.verify) and not revisit:
            payload = stream.read(length - read)
            if len(payload) != length - read:
                raise ValueError(f"record is cut off: {where}")
            if self.verify and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload differs from its digest: {where}")
            if not revisit:
                size = len(payload)
        else:
            self._skip(stream, length - read)
            size = size if revisit else length - read
        values = [headers.get(h) for c, h in HEADERS.items()]
        values[list(HEADERS).index("payload_digest")] = digest
        return (*values, size, payload)


class PushingWarcReader(WarcReader):
    """Spark accepts this method only where filters are pushed down to Python sources."""

    def pushFilters(self, filters):  # noqa: N802
        """Equality on a header column is decided from the header; Spark keeps all other filters."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            header = HEADERS.get(name)
            if header and name != "payload_digest" and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append((header, frozenset([f.value])))
            elif header and name != "payload_digest" and isinstance(f, In):
                self.wanted.append((header, frozenset(v for v in f.value if v is not None)))
            else:
                yield f


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA + (", payload binary" if self.options.get("payload", "true").lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingWarcReader if pushes else WarcReader)(dict(self.options))


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of the archives below ``path``, a file or folder."""
    spark.dataSource.register(WarcSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("warc").options(pushdown=pushes, **options).load(path)


def base32_sha1(payload: Column) -> Column:
    digits = F.sha1(payload)
    out = []
    for k in range(8):
        value = F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
               min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives below ``path``, one file for each partition of ``pages``; record ids are ``urn:page:<id>``."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    table = pages.select(
        F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"), F.octet_length(body).alias("size"),
        base32_sha1(body.cast("binary")).alias("digest"),
    )
    groups = table.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = broadcast_if_small(cut(groups.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "copies"))
    joined = table.join(groups, "digest", "left")
    revisit = F.coalesce((F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    address = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", address),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n\r"),
    )
    # The text sink ends every value with \n, the last byte of a record.
    joined.select(record.alias("value")).write.option("lineSep", "\n").text(path)


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """What the archives of ``pages`` say of every page; each payload read is checked against its digest."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    uri = path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)
    records = read_warc(spark, uri, payload="false", verify="true", types="response,revisit")
    return records.select(
        page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_number(F.col("refers_to")).alias("refers_to"),
    )
