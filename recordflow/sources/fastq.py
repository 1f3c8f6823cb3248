"""FASTQ files as a Python data source that reads each byte of a file once.

Files are cut into byte ranges. A range owns the records that begin in it: it looks for the first of them
at its start and reads the last one over its end. A record is four lines, the first beginning with ``@``, the third with
``+``, sequence and quality equally long. Quality lines may begin with either mark, so a range tries all four
ways to count lines by four, over as many lines as it takes until one is left. If the file's end leaves several,
lines are counted from the file's start, which is exact and hardly ever needed. Each range also checks the
record behind its last one, so what is not a record fails, wherever the file is cut.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from recordflow.functions.text import glob_to_regex

SCHEMA = "file string, id string, seq string, qual string"
BATCH_BYTES = 4 * 1024 * 1024
BUFFER_BYTES = 1024 * 1024
# Lines read at first to find a range's records.
TRIAL_LINES = 64

_ARROW = pa.schema([(name, pa.string()) for name in ("file", "id", "seq", "qual")])
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class Ranges(InputPartition):
    """``(path, start, stop)`` each; no stop for a file that is read as a stream."""

    pieces: tuple[tuple[str, int, int | None], ...]

    def __init__(self, pieces: tuple[tuple[str, int, int | None], ...]):
        super().__init__(0)
        self.pieces = pieces


def _open(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system of a path (plain, or a URI without escapes), the path inside it, and what of the URI stands before that."""
    found = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)", path)
    if found is None or found[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path), "file://"
    system, root = fs.FileSystem.from_uri(found[0] + "/")
    root = root.rstrip("/")
    return system, root + path[found.end() :], found[0].removesuffix(root)


def expand_braces(glob: str) -> list[str]:
    """The globs that ``{a,b}`` in one stands for."""
    found = re.search(r"\{([^{}]*)\}", glob)
    if found is None:
        return [glob]
    return [g for part in found[1].split(",") for g in expand_braces(glob[: found.start()] + part + glob[found.end() :])]


def _text(line: bytes) -> bytes:
    return line.removesuffix(b"\n").removesuffix(b"\r")


def _length(line: bytes) -> int:
    """Characters of a line."""
    text = _text(line)
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def is_record(lines: list[bytes]) -> bool:
    """Whether four lines, as they stand in the file, are a record; an empty last line may be missing at the file's end."""
    title, seq, plus, qual = lines
    return title.startswith(b"@") and plus.startswith(b"+") and plus.endswith(b"\n") and _length(seq) == _length(qual)


def _fail(lines: list[bytes]) -> None:
    raise ValueError(f"not a four-line FASTQ record: {b''.join(lines)[:200].decode('utf-8', 'replace')}")


def first_record(stream: io.BufferedIOBase, start: int) -> int:
    """Place of the first record that begins at ``start`` or behind it, or of the end of the file."""
    if start == 0:
        return 0
    # A record begins at a line; if the byte before is a line break, at this one.
    stream.seek(start - 1)
    stream.readline()
    begin, ends, lines, phases = stream.tell(), [], [], [0, 1, 2, 3]
    ends.append(begin)
    while True:
        more = max(TRIAL_LINES, len(lines))
        got = [line for line in (stream.readline() for _ in range(more)) if line]
        lines += got
        for line in got:
            ends.append(ends[-1] + len(line))
        closed = len(got) < more
        phases = [p for p in phases if p <= len(lines) and _counts(lines, p, closed)]
        if len(phases) == 1:
            return ends[phases[0]]
        if not phases:
            _fail(lines[:4])
        if closed:
            break
    # Several ways to count fit to the end of the file: only its start tells.
    stream.seek(0)
    before = sum(1 for _ in iter(lambda: stream.readline() if stream.tell() < begin else b"", b""))
    phase = -before % 4
    if phase not in phases:
        _fail(lines[:4])
    return ends[phase]


def _counts(lines: list[bytes], phase: int, closed: bool) -> bool:
    """Whether the lines from ``phase`` on are records; ``closed`` if they end with the file."""
    for k in range(phase, len(lines), 4):
        group = lines[k : k + 4]
        if len(group) == 4:
            if not is_record(group):
                return False
        elif closed:
            if len(group) < 3 or not is_record([*group, b""]):
                return False
        elif not group[0].startswith(b"@") or (len(group) > 2 and not group[2].startswith(b"+")):
            return False
    return True


def _records(stream: io.BufferedIOBase, stop: int | None) -> Iterator[tuple[bytes, bytes, bytes]]:
    """``(title, sequence, quality)`` of the records from here on that begin before ``stop``."""
    place = stream.tell()
    while True:
        lines = [stream.readline() for _ in range(4)]
        if not lines[0]:
            return
        if not is_record(lines):
            _fail(lines)
        if stop is not None and place >= stop:
            return
        place += sum(map(len, lines))
        yield _text(lines[0]), _text(lines[1]), _text(lines[3])


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.split = json.loads(options["paths"]), max(1, int(options["split"]))
        self.globs = [re.compile(glob_to_regex(g)) for g in expand_braces(options["glob"])] if "glob" in options else None

    def _files(self) -> Iterator[tuple[str, int]]:
        for path in self.paths:
            system, inside, head = _open(path)
            info = system.get_file_info(inside)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inside))
            for f in sorted(found, key=lambda f: f.path):
                shown = info.is_file or not f.base_name.startswith(("_", "."))
                if f.is_file and shown and (self.globs is None or any(g.fullmatch(f.base_name) for g in self.globs)):
                    yield head + f.path, f.size or 0

    def partitions(self) -> list[InputPartition]:
        groups: list[list] = []
        room = 0
        for path, size in self._files():
            cuts = [None] if path.endswith(_COMPRESSED) else range(0, size, self.split)
            for start in cuts:
                piece = (path, 0, None) if start is None else (path, start, min(start + self.split, size))
                weight = size if start is None else piece[2] - start
                if not groups or weight > room:
                    groups.append([])
                    room = self.split
                groups[-1].append(piece)
                room -= weight
        return [Ranges(tuple(g)) for g in groups] or [Ranges(())]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, stop in partition.pieces:
            system, inside, _ = _open(path)
            name = path.removesuffix(inside) + quote(inside)
            if stop is None:
                with system.open_input_stream(inside, compression="detect") as raw:
                    yield from self._batches(_records(_Stream(raw), None), name)
                continue
            with system.open_input_file(inside) as raw:
                stream = io.BufferedReader(raw, BUFFER_BYTES)
                at = first_record(stream, start)
                if at < stop:
                    stream.seek(at)
                    yield from self._batches(_records(stream, stop), name)

    @staticmethod
    def _batches(records: Iterator[tuple[bytes, bytes, bytes]], name: str) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            text = [b.decode("utf-8", "replace") for row in rows for b in row]
            ids = [(t[1:].split(maxsplit=1) or [""])[0] for t in text[::3]]
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.string()), pa.array(ids, pa.string()), pa.array(text[1::3], pa.string()), pa.array(text[2::3], pa.string())],
                schema=_ARROW)

        for row in records:
            rows.append(row)
            size += sum(map(len, row))
            if size > BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class _Stream(io.BufferedReader):
    """Lines of a stream that knows no places."""

    def __init__(self, raw: pa.NativeFile):
        super().__init__(raw, BUFFER_BYTES)

    def tell(self) -> int:
        return 0


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(dict(self.options))
