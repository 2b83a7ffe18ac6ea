"""S1, S2, S4, ST1: lines of text files as byte ranges, for batch and streams.

A Python data source, ``eventfold_lines``. Files are read in byte ranges: a line
belongs to the range in which it starts, is read to its end, and carries its end
offset, so lines of any split have exact positions without a second scan. A
range reads its own bytes and what its last line needs beyond them; a partition
takes small ranges, and small files, together. Reading starts at given offsets by file: bytes before them are
never opened. As a stream, the offset is the map of files to bytes read, and a
trigger reads what came since in ranges of bounded size; several files of one
trigger keep their arrival order:

``position`` counts bytes in arrival order: of all ranges read before it
(earlier triggers, then files in path order), then within the range. For files
that are there from the start it is what the batch reader gives.
``file_position`` is the end of the line in its own file.

Files are read through Arrow's file systems (local, HDFS, object stores).
Compressed files are refused: ``records.lines_with_positions`` reads them. By
default a last line without newline counts; with ``tail=true`` it is left until
it ends. The driver holds one entry a file, as Spark's own file source does.
Hidden files (``_`` or ``.`` first) are skipped.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "eventfold_lines"
SCHEMA = "value string, source string, position bigint, file_position bigint"
#: Default bytes of a range, of a read, and of an Arrow batch.
RANGE, READ = 128 << 20, 4 << 20
#: Bytes of the ranges that one partition takes together, and of the first read
#: behind a range's end (the next ones double).
TASK, SEAM = 8 << 20, 4 << 10
PACKED = re.compile(r"\.(gz|bz2|zst|lz4|snappy|deflate)\Z", re.IGNORECASE)


@dataclass
class Range(InputPartition):
    """Lines of ``source`` that start in [start, end); ``stop`` is how far the
    file may be read, ``base`` the position of byte ``start``."""

    source: str
    start: int
    end: int
    stop: int
    base: int
    first: bool  # byte ``start`` starts a line


@dataclass
class Task(InputPartition):
    """Runs of neighbouring ranges, one run a file, which one partition cuts into
    ranges of ``size`` bytes when it reads them."""

    runs: list[Range]
    size: int


def file_system(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"\Afile:/*", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> dict[str, int]:
    """Sizes of the files at ``path`` (a file or a folder), by URI, in path order."""
    from pyarrow import fs
    system, inner = file_system(path)
    prefix = "file://" if isinstance(system, fs.LocalFileSystem) else path[:len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner.rstrip("/") if len(inner) > 1 else inner)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
        top = len(inner.rstrip("/")) + 1
        found = [f for f in found if not any(p[:1] in "_." for p in f.path[top:].split("/"))]
    if packed := [f.path for f in found if PACKED.search(f.path)]:
        raise ValueError(f"compressed files have no byte ranges: {packed[0]}")
    return {prefix + f.path: f.size for f in sorted(found, key=lambda f: f.path)}


def exists(path: str) -> bool:
    from pyarrow import fs
    system, inner = file_system(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def whole_lines(source: str, start: int, size: int) -> int:
    """End of the last line of the file that a newline ends, at most ``size``."""
    system, inner = file_system(source)
    with system.open_input_file(inner) as f:
        end = size
        while end > start:
            at = max(start, end - READ)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return start


def cut(run: Range, size: int) -> Iterator[Range]:
    """The ranges of ``size`` bytes of a run."""
    for at in range(run.start, run.end, size):
        yield Range(run.source, at, min(at + size, run.end), run.stop, run.base + at - run.start, run.first and at == run.start)


def ranges(start: dict[str, int], end: dict[str, int], base: int, size: int) -> list[Range]:
    """What lies between two maps of offsets, in path order."""
    out = []
    for source in sorted(end):
        at, stop = start.get(source, 0), end[source]
        out += cut(Range(source, at, stop, stop, base, True), size)
        base += max(0, stop - at)
    return out


def tasks(start: dict[str, int], end: dict[str, int], base: int, size: int) -> list[Task]:
    """The same ranges in path order, small ones taken together: as many partitions
    as the bytes need, whatever the size of a range."""
    out, held = [], TASK
    for run in ranges(start, end, base, max(1, TASK // size) * size):
        if held + run.end - run.start > TASK:
            out.append(Task([], size))
            held = 0
        out[-1].runs.append(run)
        held += run.end - run.start
    return out


def task_lines(task: Task) -> Iterator[pa.RecordBatch]:
    """The lines of a task's ranges; a file is opened once a run."""
    for run in task.runs:
        system, inner = file_system(run.source)
        with system.open_input_file(inner) as f:
            for part in cut(run, task.size):
                yield from range_lines(part, f)


def lines(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that start in a range, with their end offsets."""
    yield from task_lines(Task([part], max(1, part.end - part.start)))


def range_lines(part: Range, f) -> Iterator[pa.RecordBatch]:
    """The lines that start in a range of the open file ``f``."""
    # the byte before the range tells whether its first byte starts a line
    at = part.start - (not part.first)
    f.seek(at)
    rest, skip = [], not part.first  # the unfinished line's pieces
    beyond = SEAM
    while at < part.stop:
        size = part.end - at
        if size <= 0:  # the end of the range's last line
            size, beyond = beyond, 2 * beyond
        data = f.read(min(READ, size, part.stop - at))
        if not data:
            break
        at += len(data)
        rest.append(data)
        if b"\n" not in data and at < part.stop:
            if skip and at >= part.end:
                return  # no line starts in this range
            continue
        buffer = b"".join(rest)
        begin = at - len(buffer)  # offset of the buffer's first byte
        pieces = buffer.split(b"\n")
        rest = [pieces.pop()]
        last = at >= part.stop and rest[0] != b""  # no newline at the end of the file
        if last:
            pieces += rest
            rest = []
        values, ends = [], []
        done = False
        for k, piece in enumerate(pieces):
            over = begin + len(piece) + (0 if last and k == len(pieces) - 1 else 1)
            if skip:
                skip = False
            elif begin >= part.end:
                done = True
                break
            else:
                values.append(piece)
                ends.append(over)
            begin = over
        if values:
            end = pa.array(ends, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.removesuffix(b"\r").decode("utf-8", "replace") for v in values], pa.string()),
                 pa.repeat(pa.scalar(part.source, pa.string()), len(values)),
                 pa.array([part.base + e - part.start for e in ends], pa.int64()), end],
                ["value", "source", "position", "file_position"])
        if done or (begin >= part.end and not skip):
            return


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE))
        self.start = json.loads(options.get("offsets", "{}"))
        self.end = json.loads(options["until"]) if "until" in options else None
        self.base = int(options.get("base", sum(self.start.values())))

    def partitions(self) -> list[Task]:
        return tasks(self.start, listed(self.path) if self.end is None else self.end, self.base, self.size)

    def read(self, partition: Task | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks once where there is nothing to read
            yield from task_lines(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE))
        self.tail = options.get("tail", "false").lower() == "true"
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}, "read": 0}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        if self.tail:
            for source, size in files.items():
                before, end = self.known.get(source, (0, 0))
                if size != before:
                    self.known[source] = (size, whole_lines(source, end, size))
                files[source] = self.known[source][1]
        return {"files": {s: n for s, n in files.items() if n}, "read": sum(files.values())}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        return tasks(start["files"], end["files"], start["read"], self.size)

    def read(self, partition: Task | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks once where there is nothing to read
            yield from task_lines(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> StreamReader:
        return StreamReader({k.lower(): v for k, v in self.options.items()})


def read_lines(spark: SparkSession, path: str, offsets: dict[str, int] | None = None,
               until: dict[str, int] | None = None, range_bytes: int = RANGE, base: int | None = None) -> DataFrame:
    """(value, source, position, file_position) of the lines beyond ``offsets``
    (bytes read by file) and up to ``until`` (by default the files' sizes).
    Positions go on behind ``base``, by default the sum of the offsets."""
    spark.dataSource.register(Lines)
    reader = spark.read.format(NAME).option("offsets", json.dumps(offsets or {})).option("rangeBytes", range_bytes)
    if until is not None:
        reader = reader.option("until", json.dumps(until))
    if base is not None:
        reader = reader.option("base", base)
    return reader.load(path)


def stream_lines(spark: SparkSession, path: str, tail: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """The same as a stream: files may be added, and grow, while it runs."""
    spark.dataSource.register(Lines)
    return spark.readStream.format(NAME).option("tail", str(tail).lower()).option("rangeBytes", range_bytes).load(path)


LEDGER = "source string, size bigint, offset bigint"


def ledger(spark: SparkSession, path: str, lines_read: DataFrame | None = None) -> DataFrame:
    """(source, size, offset): how far each file of ``path`` has been read:
    to the last of ``lines_read``, or to its end if none are given. Meant to be
    written next to what was made of the lines, and given to ``resume``."""
    files = spark.createDataFrame(list(listed(path).items()), "source string, size bigint")
    if lines_read is None:
        return files.select("source", "size", F.col("size").alias("offset"))
    read = lines_read.groupBy("source").agg(F.max("file_position").alias("offset"))
    return files.join(read, "source", "left").select("source", "size", F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"))


def resume(spark: SparkSession, path: str, ledger_: DataFrame, until: dict[str, int] | None = None,
           base: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The lines that a ledger has not seen. A file that is shorter than its
    recorded offset was replaced and is read from its start."""
    seen = {r["source"]: r["offset"] for r in ledger_.select("source", "offset").collect()}
    until = listed(path) if until is None else until
    base = sum(seen.values()) if base is None else base
    return read_lines(spark, path, {s: n for s, n in seen.items() if n <= until.get(s, -1)}, until, range_bytes, base)
