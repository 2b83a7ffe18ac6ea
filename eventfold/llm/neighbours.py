"""Operator 11: approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one class, led by its smallest id; of a class only its
smallest ids can be reported, so eleven are kept (the limit is applied before
the shuffle). Each of several orderings projects the vectors to a few random
directions, turns each direction into levels of equal frequency with a random
shift, and takes the Hilbert index of the levels as key. Spark range-partitions
(ordering, key, class), which gives every class its position in each ordering.

A query looks at all classes at most ``window`` positions away in each
ordering. An ordering is cut into blocks of positions; the rows of a block are
held by a task while the queries whose windows reach into it stream past, each
leaving its nearest ones. The windows of all orderings are merged by class and
ranked by the exact distance in double precision.

What is fitted, and its bounds: levels on ``LEVEL_SAMPLE`` classes, and the
window on ``WINDOW_SAMPLE`` queries, whose true neighbours one pass over all
classes finds; the window is the shift that holds ``target`` of these. Vectors
without structure need windows that grow with the table; the window is never
cut to save work. All rows are indexed, none is sampled.

Rows: vectors that are null, empty, zero, of another length than the commonest
one (of equally common ones the shorter), or that hold a null, NaN or infinite
component take no part, nor do rows without an id. Rows with the same id and
vector are separate rows: each finds the other. An empty table gives no rows.
Other columns are not read. Task memory: one block and one batch of queries.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.llm.common import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDERINGS, DIRECTIONS, BITS = 16, 12, 5
#: Orderings whose blocks are shuffled at once, and positions of a block.
AT_ONCE, BLOCK = 4, 2048
LEVEL_SAMPLE, WINDOW_SAMPLE, LEAST_WINDOW = 8192, 96, 64
SCHEMA = "query_id long, rank int, vec_id long, score double"


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (int64) of rows of integer coordinates below 2**bits:
    the coordinates are turned into the transposed index bit by bit, from the
    top, undoing the exchanges and inversions of each sub-cube."""
    x = levels.astype(np.int64).copy()
    n, top = x.shape[1], 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            inverted = (x[:, i] & q) != 0
            swap = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inverted, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


class Curves:
    """Directions, levels and shifts of all orderings, fitted on a sample."""

    def __init__(self, sample: np.ndarray, orderings: int, directions: int, bits: int, seed: int = 11):
        random = np.random.Generator(np.random.Philox(key=seed))
        self.bits, self.parts = bits, []
        for _ in range(orderings):
            towards = np.linalg.qr(random.standard_normal((sample.shape[1], min(directions, sample.shape[1]))))[0]
            # a shift moves all cuts of a direction by a part of a level
            at = (np.arange(1, 1 << bits)[:, None] - random.random(towards.shape[1])[None, :]) / (1 << bits)
            cuts = np.stack([np.quantile(y, a) for y, a in zip((sample @ towards).T, at.T, strict=True)])
            self.parts.append((towards, cuts))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        for towards, cuts in self.parts:
            y = vectors @ towards
            out.append(hilbert(np.stack([np.searchsorted(c, y[:, i], side="right") for i, c in enumerate(cuts)], 1), self.bits))
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def nearest(queries: np.ndarray, rows: np.ndarray, leads: np.ndarray, k: int,
            allowed: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k nearest rows as (distances, places), ties to the
    smaller lead. The product form only preselects, with room for its rounding; the
    distance is that of the differences."""
    near = (queries ** 2).sum(1)[:, None] + (rows ** 2).sum(1)[None, :] - 2 * (queries @ rows.T)
    room = 1e-9 * (1 + np.abs(queries).max(initial=0) ** 2 + np.abs(rows).max(initial=0) ** 2) * rows.shape[1]
    if allowed is not None:
        near[~allowed] = np.inf
    out = []
    for i, d in enumerate(near):
        bound = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        at = np.flatnonzero((d <= bound + room) & (d < np.inf))
        exact = np.sqrt(((rows[at] - queries[i]) ** 2).sum(1))
        order = np.lexsort((leads[at], exact))[:k]
        out.append((exact[order], at[order]))
    return out


FOUND = "qid long, cid long, lead long, score double"


def listed(queries: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], cids: pa.Array, leads: pa.Array) -> pa.RecordBatch:
    """What ``nearest`` found, one row each."""
    at = pa.array(np.concatenate([c for _, c in found]))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, [len(d) for d, _ in found])), cids.take(at), leads.take(at),
                                       pa.array(np.concatenate([d for d, _ in found]))], ["qid", "cid", "lead", "score"])


def taking_part(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and the vectors' length (0: none)."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))
    commonest = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    dim = commonest["n"] if commonest else 0
    return v.where(F.size("v") == dim), dim


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, lead, ids, v): equal vectors as one class with its smallest ids.
    Ids may repeat, so a class has a number of its own, fixed once written."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.monotonically_increasing_id().alias("cid"), F.get("ids", F.lit(0)).alias("lead"), "ids", "v")


def sample_of(classes: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n`` classes, taken by a hash of their lead: (ids, vectors)."""
    got = classes.select("cid", "v").orderBy(F.xxhash64("lead"), "lead", "cid").limit(n).toArrow()
    return got["cid"].to_numpy(), matrix(got["v"].combine_chunks(), dim)


def positions(classes: DataFrame, curves: Curves, dim: int) -> DataFrame:
    """(cid, t, pos): each class's place in each ordering, counted within its
    range partition and added up over the partitions (one row each)."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, key in enumerate(curves.keys(matrix(batch.column(1), dim))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), batch.column(0)], ["t", "key", "cid"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, done = TaskContext.get().partitionId(), {}
        for batch in batches:
            t = batch.column(0).to_numpy()
            within = np.empty(len(t), np.int64)
            for x in np.unique(t):
                mine = np.flatnonzero(t == x)
                within[mine] = done.get(x, 0) + np.arange(len(mine))
                done[x] = done.get(x, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(len(t), part, np.int32)), pa.array(within)], ["t", "cid", "part", "within"])

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = staged(classes.select("cid", "v").mapInArrow(keyed, "t int, key long, cid long"), "ann-keys")
    ranged = keys.repartitionByRange(n, "t", "key", "cid").sortWithinPartitions("t", "key", "cid")
    at = staged(ranged.mapInArrow(counted, "t int, cid long, part int, within long"), "ann-places")
    before = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")).select("t", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return staged(at.join(starts, ["t", "part"]).select("cid", "t", (F.col("start") + F.col("within")).alias("pos")), "ann-positions")


def fit_window(classes: DataFrame, places: DataFrame, dim: int, k: int, target: float, sample: int) -> int:
    """Positions to look at on each side, from the true neighbours of a bounded
    sample of classes. Only these neighbours' places come to the driver."""
    spark = classes.sparkSession
    ids, vectors = sample_of(classes, sample, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield listed(ids, nearest(vectors, matrix(batch.column(2), dim), batch.column(1).to_numpy(), k + 1), *batch.columns[:2])

    near = classes.select("cid", "lead", "v").mapInArrow(scan, FOUND).where("qid <> cid")
    best = near.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("score", "lead", "cid"))).where(F.col("rn") <= k)
    pairs = [(r["qid"], r["cid"]) for r in best.select("qid", "cid").collect()]
    if not pairs:
        return LEAST_WINDOW
    wanted = spark.createDataFrame([(int(x),) for x in {i for p in pairs for i in p}], "cid long")
    place: dict[int, dict[int, int]] = {}
    for r in places.join(F.broadcast(wanted), "cid").collect():
        place.setdefault(r["cid"], {})[r["t"]] = r["pos"]
    shifts = sorted(min(abs(place[a][t] - place[b][t]) for t in place[a]) for a, b in pairs)
    return max(LEAST_WINDOW, shifts[min(len(shifts) - 1, int(np.ceil(target * len(shifts))) - 1)])


def windows(classes: DataFrame, asked: DataFrame, places: DataFrame, orderings: list[int], window: int, dim: int, k: int) -> DataFrame:
    """(qid, cid, lead, score) of the k nearest classes of each query class in each
    block that its windows in these orderings reach."""
    there = places.where(F.col("t").isin(orderings))
    held = there.join(classes.select("cid", "lead", "v"), "cid").select(
        "t", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), F.lit(0).alias("kind"), "cid", "lead", "pos", "v")
    reach = F.sequence(F.floor(F.greatest(F.col("pos") - window, F.lit(0)) / BLOCK).cast("long"), F.floor((F.col("pos") + window) / BLOCK).cast("long"))
    asking = there.join(asked.select("cid").join(classes.select("cid", "lead", "v"), "cid"), "cid").select(
        "t", F.explode(reach).alias("block"), F.lit(1).alias("kind"), "cid", "lead", "pos", "v")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []  # the block's rows come before its queries
        rows = cids = leads = pos = None
        for batch in batches:
            t, block, kind = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip(np.append(0, cut), np.append(cut, len(t)), strict=True):
                if s == e:
                    continue
                if (t[s], block[s]) != here:
                    here, parts, rows = (t[s], block[s]), [], None
                piece = [*(batch.column(i).to_numpy()[s:e] for i in (3, 4, 5)), matrix(batch.column(6).slice(s, e - s), dim)]
                if kind[s] == 0:
                    parts.append(piece)
                    rows = None
                elif parts:
                    if rows is None:
                        cids, leads, pos, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
                    for a in range(0, e - s, 256):
                        q, _, at, vec = (x[a:a + 256] for x in piece)
                        found = nearest(vec, rows, leads, k, np.abs(at[:, None] - pos[None, :]) <= window)
                        yield listed(q, found, pa.array(cids), pa.array(leads))

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.unionByName(asking).repartition(n, "t", "block").sortWithinPartitions("t", "block", "kind") \
        .mapInArrow(look, FOUND)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, target: float = 0.96, orderings: int = ORDERINGS,
               id_col: str = "vec_id", vec_col: str = "embedding", window: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row.
    ``is_query`` is a condition on ``vec_id``."""
    spark: SparkSession = vectors.sparkSession
    rows, dim = taking_part(vectors, id_col, vec_col)
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    classes = staged(classes_of(rows, k + 1), "ann-classes")
    queries = staged(rows.where(is_query).join(classes.select("cid", "v"), "v").select("vec_id", "cid"), "ann-queries")
    asked = queries.select("cid").distinct()
    curves = Curves(sample_of(classes, LEVEL_SAMPLE, dim)[1], orderings, DIRECTIONS, BITS)
    places = positions(classes, curves, dim)
    window = window or fit_window(classes, places, dim, k, target, WINDOW_SAMPLE)
    found = None
    for first in range(0, orderings, AT_ONCE):
        part = staged(windows(classes, asked, places, list(range(first, min(first + AT_ONCE, orderings))), window, dim, k + 1), "ann-found")
        found = part if found is None else found.unionByName(part)
    # The same class from several windows has the same distance.
    merged = found.groupBy("qid", "cid", "lead").agg(F.min("score").alias("score"))
    best = merged.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("score", "lead", "cid"))).where(F.col("rn") <= k + 1)
    lists = best.join(classes.select("cid", "ids"), "cid").groupBy("qid").agg(
        F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("id")))))).alias("near"))
    # One occurrence of the query itself goes: its own row, at distance 0.
    own = F.array_position("near", F.struct(F.lit(0.0).alias("score"), F.col("vec_id").alias("id"))).cast("int")
    others = F.when(own > 0, F.filter("near", lambda x, i: i != own - 1)).otherwise(F.col("near"))
    out = queries.join(lists, queries["cid"] == lists["qid"]).select(F.col("vec_id").alias("query_id"), F.slice(others, 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
