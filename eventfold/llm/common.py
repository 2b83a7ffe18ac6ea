"""Helpers shared by the training-data operators.

Functions of these modules run in Python workers and are pickled by value,
so executors need not have the package installed.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_state(key: object, build: Callable[[], object]) -> object:
    """``build()`` once per Python worker, kept between the tasks it runs.

    A function pickled by value gets new globals with every task, so the
    value is held by a module of the worker's own interpreter.
    """
    holder = sys.modules.setdefault("_eventfold_worker_state", types.ModuleType("_eventfold_worker_state"))
    if not hasattr(holder, "values"):
        holder.values = {}
    if key not in holder.values:
        holder.values[key] = build()
    return holder.values[key]


def staged(df: DataFrame, purpose: str, settings: dict[str, str] | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to a new folder in the cluster's shared folder and read it
    back: the lineage is cut and each row is computed once, also after the
    loss of an executor. The write's shuffle files go as soon as it ends.
    ``settings`` are the session's for the write; ``file_rows``, if not 0, are
    the most rows of a file."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (settings or {})
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        out = df.write.option("compression", "zstd")
        (out.option("maxRecordsPerFile", file_rows) if file_rows else out).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1] \
        if n else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if n else None
    if data is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def tidy() -> None:
    """Give freed memory back to the system: a worker waits between tasks with
    what its allocators keep, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_bytes(batches: Iterator[pa.RecordBatch], text_col: str = "text",
             limit: int = (4 << 20) - 2) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes (a longer text is one slice), so
    that the arrays made from a slice stay small however long the texts are.
    The limit leaves room below a power of two, where ``powers`` doubles."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text_col)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    tidy()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Odd multiplier of the prefix hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n at least, kept by the worker."""
    held = worker_state("powers", dict)
    if len(held.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, x in (("up", BASE), ("down", INVERSE)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                out[done:2 * done] = out[:done] * np.uint64(pow(x, done, 1 << 64))
                done *= 2
            held[name] = out
    return held["up"], held["down"]


def byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; with ``lower`` A-Z count as a-z."""
    values = np.random.Generator(np.random.Philox(key=20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial hash of each prefix; the hash of [s, e) is
    ``(p[e] - p[s]) * INVERSE**s``, equal for equal content anywhere."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][:len(values)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes for which ``is_word``) of the
    rows, and each row's first word's number (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = np.empty(n, dtype=bool)  # a word's first byte; words end with their row
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    first &= inside
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = True
    last &= inside
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p = prefix_hashes(byte_values(lower)[data])
    return mix((p[e] - p[s]) * powers(n + 1)[1][s]), np.searchsorted(s, offsets)
