"""Operator 2: resharding by minimum-cost flow.

Old shards have row counts and bytes; new shards have row capacities that are
at most one apart. Blocks are the rows of one old shard and one size class.
The flow sends each block's rows either home, at no cost, or through a pool to
any shard with room, at the block's mean bytes a row; the cheapest flow is the
set of block transfers that moves the fewest bytes. Spark counts the blocks,
the driver solves the flow over them (their number depends on shards and size
classes only), and Spark numbers and places the rows.

Law ``rows``: the counts of the new shards are at most one apart. Slots run
from 0 without a gap in each shard.

Large blocks are numbered in 256 hash parts, whose first numbers come from a
running sum of part counts, so no old shard, however hot, is one task's work.

Rows: null text has no bytes (size 16, checksum 0); rows whose old shard is
null have no home, so all of them move; repeated rows are rows like any other;
an empty table gives no row. Rows alike in id and text are told apart by their
other columns, which must be of types that can be sorted (no maps) to be carried.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256
#: Stands for a null old shard; it is the home of no new one.
NOWHERE = 2**31 - 1


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.arcs: dict[object, list[list]] = defaultdict(list)

    def arc(self, a: object, b: object, room: int, cost: float) -> list:
        there, back = [b, room, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        self.arcs[a].append(there)
        self.arcs[b].append(back)
        return there

    def solve(self, source: object, sink: object) -> int:
        """Send as much as there is room for, at least cost; the amount."""
        nodes = list(self.arcs)
        high = dict.fromkeys(nodes, 0.0)
        sent = 0
        while True:
            far, by, tick = {source: 0.0}, {}, itertools.count()
            heap, done = [(0.0, next(tick), source)], set()
            while heap:
                d, _, a = heapq.heappop(heap)
                if a in done:
                    continue
                done.add(a)
                for arc in self.arcs[a]:
                    if arc[1] > 0 and arc[0] not in done:
                        e = d + max(0.0, arc[2] + high[a] - high[arc[0]])
                        if e < far.get(arc[0], float("inf")):
                            far[arc[0]], by[arc[0]] = e, (a, arc)
                            heapq.heappush(heap, (e, next(tick), arc[0]))
            if sink not in done:
                return sent
            for a in done:
                high[a] += far[a]
            for a in nodes:
                if a not in done:
                    high[a] += max(far[x] for x in done)
            path, a = [], sink
            while a != source:
                a, arc = by[a]
                path.append(arc)
            amount = min(arc[1] for arc in path)
            for arc in path:
                arc[1] -= amount
                arc[3][1] += amount
            sent += amount


def transfers(blocks: list[tuple[int, int, int, int]], shards: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """blocks: (old shard, size class, rows, bytes). The rows of each block by
    new shard, home first; row capacities are equal but for one."""
    total = sum(b[2] for b in blocks)
    low, extra = divmod(total, shards)
    flow, out = Flow(), {}
    home, away = {}, {}
    for old, kind, rows, size in blocks:
        flow.arc("from", (old, kind), rows, 0.0)
        if old < shards:
            home[old, kind] = flow.arc((old, kind), ("new", old), rows, 0.0)
        away[old, kind] = flow.arc((old, kind), "pool", rows, size / rows)
    spare = [flow.arc("pool", ("new", s), total, 0.0) for s in range(shards)]
    for s in range(shards):
        flow.arc(("new", s), "to", low, 0.0)
        flow.arc(("new", s), "more", 1, 0.0)
    flow.arc("more", "to", extra, 0.0)
    flow.solve("from", "to")
    room = [[s, arc[3][1]] for s, arc in enumerate(spare) if arc[3][1]]
    for old, kind, rows, _ in blocks:
        at_home = home[old, kind][3][1] if (old, kind) in home else 0
        parts = [(old, at_home)] if at_home else []
        left = rows - at_home
        while left:
            n = min(left, room[0][1])
            parts.append((room[0][0], n))
            left -= n
            room[0][1] -= n
            if not room[0][1]:
                room.pop(0)
        out[old, kind] = parts
    return out


def size_class(size: Column) -> Column:
    """Four classes for each doubling of the size."""
    return F.floor(F.log2(size.cast("double")) * 4).cast("int")


def reshard(docs: DataFrame, old: Column, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot, grown_shard,
    old_shard, moved; with ``carry`` also ``row``, the whole input row.
    ``old`` is the row's old shard (from 0 up)."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = [F.struct("*").alias("row")] if carry else []
    kept = ["row"] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(old.cast("int"), F.lit(NOWHERE)).alias("old_shard"), *whole) \
        .select("doc_id", "old_shard", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *kept) \
        .withColumn("kind", size_class(F.col("size"))) \
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int"))
    key = ["old_shard", "kind", "part"]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    blocks = [tuple(r) for r in counted.groupBy("old_shard", "kind").agg(F.sum("n"), F.sum("bytes")).orderBy("old_shard", "kind").collect()]
    plan = transfers(blocks, shards)
    pieces, slots = [], defaultdict(int)
    for (o, kind), parts in sorted(plan.items()):
        first = 0
        for new, n in parts:
            pieces.append((o, kind, first, first + n, new, slots[new]))
            first, slots[new] = first + n, slots[new] + n
    # one row for each transfer: shards times size classes at most, whatever the data
    moves = spark.createDataFrame(pieces, "old_shard int, kind int, first long, until long, shard int, slot0 long")
    start = Window.partitionBy("old_shard", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("start", F.coalesce(F.sum("n").over(start), F.lit(0))).select(*key, "start")
    # a carried row is the last key, so that a task that runs again numbers rows as before
    within = Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size", *kept)
    numbered = rows.join(starts, key).withColumn("at", F.col("start") + F.row_number().over(within) - 1)
    placed = numbered.join(F.broadcast(moves), ["old_shard", "kind"]).where("at >= first AND at < until")
    was = F.when(F.col("old_shard") != NOWHERE, F.col("old_shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("slot0") + F.col("at") - F.col("first")).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), was.alias("old_shard"),
                         (F.col("old_shard") != F.col("shard")).alias("moved"), *kept)


def rewrite(docs: DataFrame, old: Column, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text",
            rows_a_file: int = 1_000_000) -> list[int]:
    """Write the affected shards anew under ``path``, one folder a shard; the shards written.

    A shard is affected if a row leaves or enters it, or if it has shrunk to
    none; the others' old files stay valid as they are. Every input row goes
    along whole, also with a null or repeated id; a column ``shard`` or
    ``slot`` of the input gives way to the new one. A shard's files follow its
    slots, ``rows_a_file`` in each.
    """
    placed = reshard(docs, old, shards, id_col, text_col, carry=True)
    moved = placed.where("moved")
    # at most as many rows as there are old and new shards
    touched = [r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()]
    affected = sorted(s for s in touched if s is not None and s < shards)
    others = [F.col("row").getField(f.name).alias(f.name) for f in docs.schema if f.name.lower() not in ("shard", "slot")]
    placed.where(F.col("shard").isin(affected)).select(*others, "shard", "slot") \
        .repartition("shard", F.floor(F.col("slot") / rows_a_file)).sortWithinPartitions("shard", "slot") \
        .write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)
    return affected
