"""Operator 10: n-gram Jaccard join by set-relation skipping.

A document's set holds the hashes of its distinct five-word shingles. Equal
sets are one class from the start. The join is exact: classes link where
100 * intersection >= 75 * union.

1. Shingle frequencies. Each task packs its classes' shingles by bucket (a
   class once a chunk, however many copies it has); a bucket finds the shingles
   that two or more classes have, and sends only these back to their classes.
   Buckets take turns (``TURNS``): the texts are read once a turn, and only one
   turn's shingles are in a shuffle, whose files go before the next one.
2. Index lists. A class orders its shingles rare first. Only if fewer than the
   quarter that may differ are its own can it have a partner; such a class
   enters the lists of the shared shingles in its prefix, with its size and
   position.
3. Skipping. Lists are cut into blocks by set size; a set probes only blocks
   whose sizes can reach the threshold, and a position bound skips pairs whose
   rest is too short. Each set is first compared with one hub, the leader of
   its lists; the sets near to a hub are a family. Where not all of a family
   link with their hub, they are compared once more, with the family's centre
   (the set nearest to its consensus). Sets that link with the centre are one
   component and need no comparison among them. What a set outside can still
   link with follows from the sets' differences from the consensus (see
   ``derived``), so a large group of near copies costs its differences, not
   its pairs. Pairs of different families and components are compared one by
   one, so no link is lost.

Linked answers are component numbers, so a group of copies of any size costs
its size, not the pairs in it. Rows are only shuffled by hash, and joins that
meet a frequent key are plain equi-joins, which adaptive execution splits.

Hashes have 48 bits for shingles and 64 for classes. Rows: a null text, or
one without a word, has an empty set and is its own component; fewer than five
words make one shingle; repeated rows give a row each; an id may be null (it
then never names a component that has another id).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import by_bytes, id_text, mix, staged, text_buffers, tidy, word_hashes
from eventfold.llm.components import stars
from eventfold.llm.packed import MASK, buckets, pack, planes, split, unpack, unplane

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
#: Percent of the union that the intersection must reach.
LEAST = 75
PARTS = "part int, kind int, h binary, i binary, c binary, n binary"
#: Bytes of text whose shingles are made at once; half of the default, for the arrays of a worker.
SLICE = (2 << 20) - 2
#: Turns in which the buckets of all shingles are shuffled, to bound the disk.
TURNS = 2


def separators() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 48-bit shingle hashes of each text."""
    h, first = word_hashes(*text_buffers(column), separators(), True)
    out = []
    total = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        total += h[k:len(h) - WORDS + 1 + k] * np.uint64(2 * k * k * 0x51ED2701 + 0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
    total = mix(total) & MASK
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(total[a:b - WORDS + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) + h[k])
            out.append(short & MASK)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_id(s: np.ndarray) -> int:
    """A set's class: 64 bits, the same for equal sets only."""
    one, two = (mix(x).sum(dtype=np.uint64, keepdims=True) for x in (s, s ^ np.uint64(0xA5A5A5A5A5A5)))
    return int(mix((one ^ two * np.uint64(3)) + np.uint64(len(s)))[0])


def class_table(c: np.ndarray, m: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending class numbers as differences, and their sizes; byte planes."""
    return planes(np.diff(c, prepend=np.uint64(0))), planes(m.astype("<i4"))


def class_numbers(c: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplane(c, "<u8"), dtype=np.uint64), unplane(m, "<i4")


def emit(n: int, turn: int = 0, turns: int = 1):
    """Documents to packed shingles by bucket, of one turn's buckets, and in the
    first turn the documents' own rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "kind", "h", "i", "c", "n"]
        for batch in by_bytes(batches, limit=SLICE):
            sets = shingle_sets(batch.column(1))
            size = np.array([len(s) for s in sets], dtype=np.int32)
            cid = np.array([class_id(s) if len(s) else 0 for s in sets], dtype=np.uint64)
            ids = batch.column(0)
            rows = []
            if not turn:
                rows.append((int(cid[0] % np.uint64(n)) if len(cid) else 0, 1, ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                             np.asarray(ids.is_valid().to_numpy(zero_copy_only=False)).tobytes(), cid.tobytes(), size.tobytes()))
            once = np.unique(cid, return_index=True)[1]
            once = once[size[once] > 0]
            if len(once):
                h = np.concatenate([sets[i] for i in once])
                who = np.repeat(np.arange(len(once), dtype="<u4"), size[once])
                c, m = cid[once], size[once]
                if turns > 1:
                    mine = h % np.uint64(n) % np.uint64(turns) == turn
                    h, who = h[mine], who[mine]
                order, bucket, lo, hi = split(h, n)
                h, who = h[order], who[order]
                for b, x, y in zip(bucket.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    own, at = np.unique(who[x:y], return_inverse=True)
                    rows.append((b, 0, pack(h[x:y], n), planes(at.astype("<u2" if len(own) < 65536 else "<u4")), *class_table(c[own], m[own])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.binary()) for k in range(6)], names)
    return run


def local(row, n_own: int) -> np.ndarray:
    return unplane(row, "<u2" if n_own < 65536 else "<u4").astype(np.int64)


def shared(n: int):
    """A bucket's shingles that two or more classes have, by class."""
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        out = [(int(r.part), 1, r.h, r.i, r.c, r.n) for r in group[group.kind == 1].itertuples()]
        hs, cs, ns = [], [], []
        for r in group[group.kind == 0].itertuples():
            c, m = class_numbers(r.c, r.n)
            at = local(r.i, len(c))
            hs.append(unpack(r.h, bucket, n))
            cs.append(c[at])
            ns.append(m[at])
        if hs:
            h, c, m = np.concatenate(hs), np.concatenate(cs), np.concatenate(ns)
            hs = cs = ns = None
            order = np.argsort(h)
            s = h[order]
            edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            order = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
            h, c, m = h[order], c[order], m[order]
            order = np.lexsort((c, h))
            h, c, m = h[order], c[order], m[order]
            keep = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.zeros(0, bool)
            h, c, m = h[keep], c[keep], m[keep]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
            df = np.repeat(np.diff(edge), np.diff(edge))
            h, c, m, df = h[df > 1], c[df > 1], m[df > 1], df[df > 1]
            to = (c % np.uint64(n)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            h, c, m, df, to = h[order], c[order], m[order], df[order], to[order]
            edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own, first, at = np.unique(c[x:y], return_index=True, return_inverse=True)
                at = at.astype("<u2" if len(own) < 65536 else "<u4")
                out.append((int(to[x]), 0, planes(np.diff(h[x:y], prepend=np.uint64(0))), planes(at), b"".join(class_table(own, m[x:y][first])),
                            planes(np.minimum(df[x:y], 65535).astype("<u2"))))
        hs = cs = ns = h = c = m = df = order = s = None
        tidy()
        return pd.DataFrame(out, columns=["part", "kind", "h", "i", "c", "n"])
    return run


CLASSES = "kind int, doc_id long, cid long, n long, own int, prefix array<long>, shared binary"


def ordered(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Rows of documents (kind 1), and of classes that can have a partner (kind 0)."""
    out = []
    for r in group[group.kind == 1].itertuples():
        ids, valid = np.frombuffer(r.h, "<i8"), np.frombuffer(r.i, bool)
        out.append(pd.DataFrame({"kind": 1, "doc_id": pd.array(ids, dtype="Int64").copy(), "cid": np.frombuffer(r.c, "<i8"),
                                 "n": np.frombuffer(r.n, "<i4").astype(np.int64), "own": 0, "prefix": None, "shared": None}))
        out[-1].loc[~valid, "doc_id"] = pd.NA
    hs, cs, ms, ds = [], [], [], []
    for r in group[group.kind == 0].itertuples():
        k = len(r.c) // 12
        at = local(r.i, k)
        c, m = class_numbers(r.c[:8 * k], r.c[8 * k:])
        hs.append(np.cumsum(unplane(r.h, "<u8"), dtype=np.uint64))
        cs.append(c[at])
        ms.append(m[at])
        ds.append(unplane(r.n, "<u2"))
    if hs:
        h, c, m, d = np.concatenate(hs), np.concatenate(cs), np.concatenate(ms), np.concatenate(ds)
        order = np.lexsort((h, d, c))
        h, c, m = h[order], c[order], m[order]
        edge = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True])))
        rows = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n = int(m[x])
            own, prefix = n - (y - x), n - -(-LEAST * n // 100) + 1
            if own < prefix:
                rows.append((0, None, int(c[x:x + 1].view(np.int64)[0]), n, own, h[x:x + prefix - own].astype(np.int64),
                             np.sort(h[x:y]).astype("<u8").tobytes()))
        if rows:
            out.append(pd.DataFrame(rows, columns=["kind", "doc_id", "cid", "n", "own", "prefix", "shared"]).astype({"doc_id": "Int64"}))
    if not out:
        return pd.DataFrame({"kind": [], "doc_id": [], "cid": [], "n": [], "own": [], "prefix": [], "shared": []})
    return pd.concat(out, ignore_index=True)


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, ok, near) by the intersection of the two sets; near: they differ
    in at most half of their sizes' sum."""
    sets = classes.select("cid", "n", "shared")
    both = pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, near = [], []
            for na, nb, x, y in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * common >= LEAST * (na + nb - common))
                near.append(2 * (na + nb - 2 * common) <= na + nb)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_()), pa.array(near, pa.bool_())], ["a", "b", "ok", "near"])

    return both.mapInArrow(run, "a long, b long, ok boolean, near boolean")


def families(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (a, b, ok, root) of hubs' families with na, own, away (the size of
    the difference from the family's consensus: the shingles of more than half
    of its members) and rest, the difference's shared elements: one of the
    consensus times 2, one of the member's times 2 plus 1."""
    sets = members.join(classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), "own", "shared"), "a")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["b", "es"])

    size = members.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    consensus = sets.select("b", "shared").mapInArrow(elements, "b long, es array<long>").select("b", F.explode("es").alias("e")) \
        .groupBy("b", "e").agg(F.count(F.lit(1)).alias("c")).join(size, "b").where("2 * c > size") \
        .groupBy("b").agg(F.sort_array(F.collect_list("e")).alias("base"))
    both = sets.join(consensus, "b", "left").select("a", "b", "ok", "root", "na", "own", "shared", "base")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away, rest = [], []
            for na, x, y in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.array(y or [], dtype="<u8")
                mine, theirs = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                away.append(na - len(x) + len(mine) + len(theirs))
                rest.append(np.concatenate((mine * np.uint64(2) + np.uint64(1), theirs * np.uint64(2))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(away, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
                                             ["a", "b", "ok", "root", "na", "own", "away", "rest"])

    return both.mapInArrow(differences, "a long, b long, ok boolean, root long, na long, own int, away long, rest array<long>")


def derived(family: DataFrame) -> DataFrame:
    """Pairs (a, b) of a family that can still link, from what is known of each
    member's difference D from the family's consensus.

    |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, and sets link if |x ^ y| is at most a
    seventh of |x| + |y|; with f = 7 |D| - n this is 14 |Dx & Dy| >= fx + fy.
    Members in the centre's component (ok) need no comparison among them, so
    one of a pair is outside. As its D is large, more than half of the other's
    D must be a part of it: the two D, ordered rare first, meet early in both.
    """
    family = family.withColumn("f", F.expr("7 * away - na"))
    bounds = family.groupBy("b").agg(F.min("f").alias("least"), F.min(F.when(~F.col("ok"), F.col("f"))).alias("far"))
    # the least overlap of two D that a link needs, for the set as a partner and as one outside
    need = "CAST(ceil((f + {}) / 14.0D) AS BIGINT)"
    sets = family.join(bounds, "b").withColumn("as_y", F.expr(need.format("far"))).withColumn("as_x", F.expr(need.format("least")))
    facts = ["b", "a", "ok", "root", "f", "away", "own", "as_x", "as_y"]
    flat = sets.select(*facts, F.explode_outer("rest").alias("e"))
    often = flat.groupBy(F.col("b").alias("often_b"), F.col("e").alias("often_e")).agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(often, F.expr("b = often_b AND e <=> often_e")).groupBy(*facts).agg(
        F.sort_array(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("df", "e")))).alias("d"))
    # the elements by position, behind those that no other class has; none that is alone in its list.
    # Element 0 stands for needing no common element
    def prefix(length: str):
        placed = F.transform("d", lambda z, i: F.struct(z["e"].alias("e"), (F.col("own") + i).alias("p"), z["df"].alias("df")))
        zero = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).alias("p"), F.lit(2).cast("long").alias("df"))
        within = F.filter(placed, lambda z: (z["p"] <= F.col("away") - F.col(length)) & (z["df"] > 1))
        return F.when(F.col(length) <= 0, F.concat(within, F.array(zero))).otherwise(within)
    y = ranked.select("b", F.col("a").alias("y"), F.col("root").alias("yr"), F.col("f").alias("yf"), F.col("away").alias("yd"), F.inline(prefix("as_y")).alias("e", "yp", "df")).drop("df")
    x = ranked.where("NOT ok").select("b", F.col("a").alias("x"), F.col("root").alias("xr"), F.col("f").alias("xf"), F.col("away").alias("xd"), F.inline(prefix("as_x")).alias("e", "xp", "df")).drop("df")
    # at the first common element, what is left of either D bounds the overlap
    found = x.join(y, ["b", "e"]).where("xr <> yr AND CASE WHEN e = 0 THEN xf + yf <= 0 ELSE 14 * least(xd - xp, yd - yp) >= xf + yf END")
    return found.groupBy("x", "y").agg(
        F.max(F.expr("e = 0")).alias("free"), F.count(F.lit(1)).alias("c"), F.min(F.expr("least(xd - xp, yd - yp) - 1")).alias("left"), F.first("xf").alias("xf"), F.first("yf").alias("yf")) \
        .where("free OR 14 * (c + left) >= xf + yf").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked_classes(classes: DataFrame) -> DataFrame | None:
    """(node, root) of the classes that have a partner."""
    # a block holds sizes within a factor of 4/3: partners are in the same or the next block
    entries = classes.select("cid", "n", "own", F.posexplode("prefix").alias("k", "h")).select(
        "h", "cid", "n", (F.col("own") + F.col("k")).alias("pos"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int").alias("block"))
    lists = staged(entries.join(entries.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "h").drop("many"), "join-lists")
    links = None

    def add(*found: DataFrame) -> DataFrame | None:
        """The components with the new links in."""
        pairs = found[0].where("ok").select("a", "b")
        for more in found[1:]:
            pairs = pairs.union(more.where("ok").select("a", "b"))
        if pairs.isEmpty():
            return links
        return stars(pairs if links is None else pairs.union(links.toDF("a", "b")))

    # each class and its hub: of the leaders of its lists' blocks the one with the least hash
    leader = F.min(F.struct(F.xxhash64("cid").alias("z"), F.col("cid").alias("hub")))
    hubs = lists.join(lists.groupBy("h", "block").agg(leader.alias("l")), ["h", "block"]).groupBy("cid").agg(F.min("l").alias("l"))
    first = staged(compared(hubs.where("cid <> l.hub").select(F.col("cid").alias("a"), F.col("l.hub").alias("b")), classes), "join-hubs")
    family = first.where("near").select("a", "b")

    def rooted(members: DataFrame, node: str, name: str) -> DataFrame:
        if links is None:
            return members.withColumn(name, F.col(node))
        return members.join(links.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    known = first.where("near").select("a", "b", "ok", F.col("a").alias("root"))
    known = known.join(known.where("NOT ok").select("b").distinct(), "b")
    differ = staged(families(known, classes), "join-families")
    # each member and its family's centre, the member nearest to the consensus
    centres = differ.groupBy("b").agg(F.min(F.struct("away", "a")).alias("m")).select("b", F.col("m.a").alias("centre"))
    centred = differ.join(centres, "b")
    met = staged(compared(centred.where("a <> centre").select("a", F.col("centre").alias("b")), classes), "join-centres")
    links = add(first, met)
    now = rooted(rooted(centred.drop("root", "ok"), "a", "root"), "centre", "rc").withColumn("ok", F.expr("root = rc")).drop("rc", "centre")
    second = staged(compared(derived(now), classes), "join-derived")

    # what is left: pairs of different families and components
    now = lists.join(family.select(F.col("a").alias("cid"), F.col("b").alias("fam")), "cid", "left").withColumn("fam", F.coalesce("fam", "cid"))
    now = rooted(now, "cid", "root")
    open_ = now.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("fam").alias("f0"), F.max("fam").alias("f1")) \
        .where("r0 < r1 AND f0 < f1").select("h")
    now = staged(now.join(open_, "h"), "join-open")
    x = now.select("h", F.col("block").alias("xb"), F.col("cid").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("root").alias("xr"), F.col("fam").alias("xf"),
                   F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("at"))
    y = now.select("h", F.col("block").alias("at"), F.col("cid").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("root").alias("yr"), F.col("fam").alias("yf"))
    # sizes and positions: the larger set's share, and what is left from the common shingle on
    found = x.join(y, ["h", "at"]).where("xr <> yr AND xf <> yf AND (xb > at OR x < y)") \
        .where(f"100 * least(xn, yn) >= {LEAST} * greatest(xn, yn)") \
        .where(f"{100 + LEAST} * least(xn - xp, yn - yp) >= {LEAST} * (xn + yn)")
    # all common shingles of the two prefixes are here: their number and what is left
    # behind the last of them bound the intersection
    pairs = found.groupBy("x", "y", "xn", "yn").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.least(F.expr("xn - xp - 1"), F.expr("yn - yp - 1"))).alias("rest")) \
        .where(f"{100 + LEAST} * (c + rest) >= {LEAST} * (xn + yn)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    last = staged(compared(pairs, classes), "join-rest")
    return add(second, last)


def join_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents (doc_id, n, cid) and the linked classes (node, root)."""
    n = buckets(docs)
    rows = id_text(docs)
    found = None
    for turn in range(TURNS):
        some = staged(rows.mapInArrow(emit(n, turn, TURNS), PARTS).groupBy("part").applyInPandas(shared(n), PARTS), "join-shared")
        found = some if found is None else found.union(some)
    table = staged(found.groupBy("part").applyInPandas(ordered, CLASSES), "join-classes")
    classes = table.where("kind = 0").select("cid", "n", "own", "prefix", "shared")
    return table.where("kind = 1").select("doc_id", "n", "cid"), linked_classes(classes)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, roots = join_classes(docs)
    full = rows.where("n > 0")
    if roots is not None:
        full = full.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("cid", F.coalesce("root", "cid")).drop("root")
    least = full.groupBy("cid").agg(F.min("doc_id").alias("component_id"))
    return full.join(least, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(
        rows.where("n = 0").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the smallest id (a null id last);
    of its rows alike in id, one with the smallest class. Documents with an
    empty set, which link with nothing, all stay."""
    rows, roots = join_classes(docs)
    full = rows.where("n > 0").withColumn("class", F.col("cid"))
    if roots is not None:
        full = full.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("cid", F.coalesce("root", "cid")).drop("root")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "class")
    chosen = staged(full.groupBy("cid").agg(F.min(order).alias("o")).select("o.doc_id", F.col("o.class").alias("class")), "join-chosen")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=SLICE):
            sets = shingle_sets(batch.column(2))
            cid = np.array([class_id(s) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cid), pa.array([not len(s) for s in sets], pa.bool_())],
                                             ["row", "id", "class", "empty"])

    known = named.mapInArrow(run, named.select("row", "id").schema.add("class", "long").add("empty", "boolean"))
    full = known.where("NOT empty").alias("k").join(chosen.alias("c"), F.expr("k.id <=> c.doc_id AND k.class = c.class")).select("k.*")
    # rows alike in id and set come down to one
    one = full.groupBy("id", "class").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return one.select("row.*").union(known.where("empty").select("row.*"))
