"""Sets of 48-bit hashes packed by bucket, so that a shuffle moves a few bytes
a hash instead of a row: sorted in each bucket, stored as differences, byte
planes apart (upper planes are mostly zero, which Spark's compression drops).
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASK = np.uint64((1 << 48) - 1)


def buckets(df: DataFrame, each: int = 8 << 20, text_col: str = "text") -> int:
    """Buckets by the texts' bytes, so that one holds what about ``each`` bytes of
    text make of it, however files are compressed; at least the session's
    partitions. One job that reads the texts' lengths."""
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def planes(a: np.ndarray) -> bytes:
    """Little-endian integers as byte planes."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplane(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def split(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the hashes by bucket and value, the bucket of each part of it,
    and the parts' bounds; bucket = h mod n."""
    q, r = h // np.uint64(n), h % np.uint64(n)
    order = np.argsort(r * np.uint64((1 << 48) // n + 1) + q)
    r = r[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    return order, r[first].astype(np.int64), first, np.append(first[1:], len(r))


def pack(sorted_h: np.ndarray, n: int) -> bytes:
    q = sorted_h // np.uint64(n)
    return planes(np.diff(q, prepend=np.uint64(0)))


def unpack(data: bytes, bucket: int, n: int) -> np.ndarray:
    return np.cumsum(unplane(data, "<u8"), dtype=np.uint64) * np.uint64(n) + np.uint64(bucket)
