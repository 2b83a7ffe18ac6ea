"""Operator 13: conversation structure repair by a square-root checkpointed DP.

A repaired conversation's role initials are ``(s?(ua)+)?``. Edits and costs:
Keep (0), Rerole to user or assistant (2), Delete (3, the only one for a blank
or duplicate row), Insert an empty user or assistant row (2); a truncated row
that is not deleted adds 1. Of the cheapest edits, those whose initials come
first in ASCII order are taken. The initial of a kept row and the state decide
what an edit gives, so the initials decide the whole repair.

States: nothing yet (0), after s (1), after u (2), after a (3). The least cost
from a row to the end, for each state, is a vector of four; a row maps the
vector behind it to the one before it, the same way for rows of the same kind.

Rows are range-partitioned in their order, so that a conversation of any
length spreads over tasks, and packed into blocks of bounded rows and bytes:

1. each block, alone, gives its four-by-four least costs (from state, to state);
2. one pass over these, backwards along a conversation, gives the vector at the
   end of each block: the checkpoints between blocks;
3. each block walks forward from each state it can be entered in. It stores
   backward vectors only at about root-of-its-rows checkpoints, recomputes the
   stretch behind a checkpoint when the walk reaches it, and emits the ASCII-least
   tight edits and the state it leaves in;
4. one pass forwards picks each block's entry state, and the block's rows are
   repaired.

Duplicates are found on digests of role and text, by a minimum combined before
the shuffle. Steps 2 and 4 see one short row a block.

Rows: a null role or text is one space, so such a text is blank. Turns order a
conversation, nulls first; rows of one turn are ordered by role, then text
(equal rows are alike). A null conversation id is a conversation of its own.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm.common import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bounds of a block.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
NEVER = 1 << 60
#: Costs at the end of a conversation: s needs "ua" inserted, u needs "a".
END = (0, 4, 2, 0)
#: State after an inserted or reroled row, and its role, by the state before.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Kinds of rows: initial s, u, a or other, plus 4 if truncated; or to be deleted.
GONE = 8
DIGEST = 16
WORD = re.compile(r"[^\x20\x09-\x0D]")
LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


def kept(kind: int, state: int) -> int:
    """State after the row is kept in ``state``, or -1."""
    return ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))[state][kind & 3]


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Least costs when rows may be inserted first; two can help at most."""
    for _ in range(2):
        costs = [min(c, 2 + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, NEVER) for c in costs)


@cache
def _before(kind: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    more = (kind >> 2) & 1
    costs = []
    for s in range(4):
        c = 3 + behind[s]
        if kind != GONE:
            c = min(c, 2 + more + behind[NEXT[s]])
            if (to := kept(kind, s)) >= 0:
                c = min(c, more + behind[to])
        costs.append(c)
    return with_inserts(costs)


def before(kind: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row. Rows differ by kind and vectors by their
    differences, of which there are few: these are remembered."""
    least = min(behind)
    return tuple(least + c if c < NEVER // 2 else NEVER
                 for c in _before(kind, tuple(c - least if c < NEVER else NEVER for c in behind)))


def least_costs(kinds: list[int]) -> list[int]:
    """The block's four-by-four least costs, row by row."""
    columns = []
    for to in range(4):
        vector = with_inserts([0 if s == to else NEVER for s in range(4)])
        for kind in reversed(kinds):
            vector = before(kind, vector)
        columns.append(vector)
    return [columns[to][s] for s in range(4) for to in range(4)]


def walk(kinds: list[int], end: tuple[int, ...], state: int, at_end: bool) -> tuple[str, int]:
    """The ASCII-least tight edits of a block entered in ``state``, and the
    state it leaves in. ``end`` is the vector behind its last row; inserts
    behind that row belong to the next block, or here where there is none."""
    n = len(kinds)
    step = max(1, int(n ** 0.5))
    held, vector = {}, end
    for i in range(n, -1, -1):
        if i < n:
            vector = before(kinds[i], vector)
        if i % step == 0 or i == n:
            held[i] = vector
    audit = []
    i, first, stretch = 0, 0, []
    while True:
        if i - first >= len(stretch) - 1 and i < n:  # recompute up to the next checkpoint
            first, last = i, min(n, i - i % step + step)
            vector = held[last]
            stretch = [vector]
            for j in range(last - 1, first - 1, -1):
                vector = before(kinds[j], vector)
                stretch.append(vector)
            stretch.reverse()
        here = stretch[i - first] if stretch else held[0]
        if i == n:
            if at_end:
                while here[state]:
                    audit.append("I")
                    state = NEXT[state]
            return "".join(audit), state
        kind, behind = kinds[i], stretch[i - first + 1]
        more = (kind >> 2) & 1
        if here[state] == 3 + behind[state]:  # D, I, K, R: ASCII order
            audit.append("D")
            i += 1
        elif here[state] == 2 + here[NEXT[state]]:
            audit.append("I")
            state = NEXT[state]
        elif kind != GONE and (to := kept(kind, state)) >= 0 and here[state] == more + behind[to]:
            audit.append("K")
            state = to
            i += 1
        else:
            audit.append("R")
            state = NEXT[state]
            i += 1


ROWS = "conv_id long, turn long, role string, text string"
BLOCKS = ("conv_id long, part int, seq long, turns array<long>, roles array<string>, texts array<string>, "
          "faults array<tinyint>, digests array<binary>")


def fault(text: str) -> int:
    """1: blank, 2: truncated, 0: neither."""
    if not WORD.search(text):
        return 1
    stripped = text.rstrip("\x20\t\n\x0b\x0c\r")
    return 0 if stripped[-1] in ".!?" else 2


def blocks(rows: DataFrame) -> DataFrame:
    """The rows in order, packed: (part, seq) orders the blocks."""
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    # Equal rows are alike, so that any split among them will do: the last key only parts a mass of them.
    r = staged(r.withColumn("salt", F.monotonically_increasing_id()), "turns")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "salt")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = r.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    names = ["conv_id", "part", "seq", "turns", "roles", "texts", "faults", "digests"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()),
             pa.list_(pa.int8()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, chars, here, done = TaskContext.get().partitionId(), 0, 0, None, []

        def closed(turns: list, roles: list, texts: list) -> tuple:
            digests = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:DIGEST] for r, t in zip(roles, texts, strict=True)]
            return here, part, seq, turns, roles, texts, [fault(t) for t in texts], digests

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        turns, roles, texts = [], [], []
        held = 0
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if roles and (conv != here or len(roles) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    done.append(closed(turns, roles, texts))
                    held += chars
                    seq, chars, turns, roles, texts = seq + 1, 0, [], [], []
                    if held >= BLOCK_CHARS or len(done) >= BLOCK_ROWS:
                        yield out()
                        done.clear()
                        held = 0
                here = conv
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                chars += len(text) + len(role)
        if roles:
            done.append(closed(turns, roles, texts))
        if done:
            yield out()

    return staged(in_order.mapInArrow(run, BLOCKS), "conversation-blocks")


def kinds_of(roles: list[str], faults: list[int], firsts: list[int] | None) -> list[int]:
    """Row kinds; a row that is not the first of its role and text is a duplicate."""
    first = set(firsts or ())
    return [GONE if f == 1 or i not in first else (("sua".find(r[:1]) if r else -1) % 4) + 2 * f
            for i, (r, f) in enumerate(zip(roles, faults, strict=True))]


COSTS = ("conv_id long, part int, seq long, kinds array<tinyint>, least array<long>, n_rows long, blank long, duplicate long, truncated long, "
         "illegal long, first_role string, last_role string, distinct_turns long, first_turn long, last_turn long")


def illegal_pair(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


def summaries(packed: DataFrame) -> DataFrame:
    """Step 1: kinds, least costs and counts of each block, without its texts."""
    seen = packed.select("conv_id", "part", "seq", F.posexplode("digests").alias("i", "digest"))
    firsts = seen.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq", "i")).alias("f")).select("f.*") \
        .groupBy("part", "seq").agg(F.collect_list("i").alias("firsts"))
    joined = packed.select("conv_id", "part", "seq", "turns", "roles", "faults").join(firsts, ["part", "seq"], "left") \
        .select("conv_id", "part", "seq", "turns", "roles", "faults", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seq, turns, roles, faults, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kinds = kinds_of(roles, faults, firsts)
                blank = faults.count(1)
                known = [t for t in turns if t is not None]
                out.append((conv, part, seq, kinds, least_costs(kinds), len(roles), blank, kinds.count(GONE) - blank,
                            sum(k != GONE and k >= 4 for k in kinds), sum(map(illegal_pair, roles, roles[1:])), roles[0], roles[-1],
                            len(set(known)), known[0] if known else None, known[-1] if known else None))
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int64()), *[pa.int64()] * 5,
                         pa.string(), pa.string(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in COSTS.split(", ")])

    return staged(joined.mapInArrow(run, COSTS), "conversation-costs")


def along(df: DataFrame, backwards: bool) -> DataFrame:
    """Conversations in tasks, each one's blocks in order (or the reverse)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", way("part"), way("seq"))


def checkpoints(costs: DataFrame) -> DataFrame:
    """Step 2: (part, seq, behind, first, last): the vector behind each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, vector = (), END
        for batch in batches:
            out = []
            for conv, part, seq, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = (conv,) != here
                if last:
                    here, vector = (conv,), END
                out.append((part, seq, vector, last))
                vector = tuple(min(NEVER, *(least[4 * s + to] + vector[to] for to in range(4))) for s in range(4))
            if out:
                part, seq, behind, last = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seq, pa.int64()), pa.array(behind, pa.list_(pa.int64())), pa.array(last)],
                                                 ["part", "seq", "behind", "last"])

    return along(costs.select("conv_id", "part", "seq", "least"), True).mapInArrow(run, "part int, seq long, behind array<long>, last boolean")


def walks(costs: DataFrame) -> DataFrame:
    """Step 3: each block's edits and exit, by the state it is entered in."""
    ahead = costs.select("conv_id", "part", "seq", "kinds").join(checkpoints(costs), ["part", "seq"]).select("conv_id", "part", "seq", "kinds", "behind", "last")
    schema = "conv_id long, part int, seq long, audits array<string>, exits array<int>, behind array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seq, kinds, behind, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = [walk(kinds, tuple(behind), s, last) for s in range(4)]
                out.append((conv, part, seq, [a for a, _ in both], [s for _, s in both], behind))
            if out:
                columns = zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [x.split()[0] for x in schema.split(", ")])

    return staged(ahead.mapInArrow(run, schema), "conversation-walks")


def entries(walked: DataFrame) -> DataFrame:
    """Step 4, first half: (part, seq, state, audit) of each block as entered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = (), 0
        for batch in batches:
            out = []
            for conv, part, seq, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != here:
                    here, state = (conv,), 0
                out.append((part, seq, state))
                state = exits[state]
            if out:
                part, seq, states = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seq, pa.int64()), pa.array(states, pa.int32())], ["part", "seq", "state"])

    picked = along(walked.select("conv_id", "part", "seq", "exits"), False).mapInArrow(run, "part int, seq long, state int")
    return walked.join(picked, ["part", "seq"]).select("part", "seq", "state", F.get("audits", F.col("state")).alias("audit"))


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], list[str]]:
    """The block's rows after its edits."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit in "IR":
            out_roles.append(ROLE[state])
            out_texts.append("" if edit == "I" else texts[i])
            state = NEXT[state]
        elif edit == "K":
            out_roles.append(roles[i])
            out_texts.append(texts[i])
            state = (1, 2, 3)["sua".index(roles[i][0])]
        i += edit != "I"
    return out_roles, out_texts


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, blocks of repaired rows) of rows (conv_id, turn, role, text).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    blocks: conv_id, part, seq (their order), audit, roles, texts.
    """
    packed = blocks(rows)
    costs = summaries(packed)
    walked = walks(costs)
    order = Window.partitionBy("conv_id").orderBy("part", "seq")
    known = Window.partitionBy("conv_id").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seam = costs.select(
        "*", F.lag("last_role").over(order).alias("role_before"),
        F.last("last_turn", ignorenulls=True).over(known).alias("turn_before"))
    first_of = lambda c: F.coalesce(F.substring(c, 1, 1), F.lit(""))
    crossing = F.col("role_before").isNotNull() & ~F.concat(first_of("role_before"), first_of("first_role")).isin("su", "ua", "au")
    again = F.coalesce(F.col("turn_before") == F.col("first_turn"), F.lit(False)).cast("long")
    total = seam.groupBy("conv_id").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("distinct_turns") - again), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + crossing.cast("long")).cast("long").alias("illegal"),
        F.min_by(F.struct("least", "part", "seq"), F.struct("part", "seq")).alias("head"))
    # The cost is that of the first block entered in state 0, over what is behind it.
    ahead = walked.select("part", "seq", "behind")
    to_end = F.array_min(F.zip_with(F.slice("head.least", 1, 4), "behind", lambda a, b: a + b))
    conversations = total.withColumn("part", F.col("head.part")).withColumn("seq", F.col("head.seq")).join(ahead, ["part", "seq"]) \
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", to_end.alias("cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, states, roles, texts = (batch.column(i).to_pylist() for i in range(3, 7))
            both = [repaired(r, t, a, s) for a, s, r, t in zip(audits, states, roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([r for r, _ in both], pa.list_(pa.string())), pa.array([t for _, t in both], pa.list_(pa.string()))],
                ["conv_id", "part", "seq", "audit", "roles", "texts"])

    mended = packed.select("conv_id", "part", "seq", "roles", "texts").join(entries(walked), ["part", "seq"]) \
        .select("conv_id", "part", "seq", "audit", "state", "roles", "texts") \
        .mapInArrow(run, "conv_id long, part int, seq long, audit string, roles array<string>, texts array<string>")
    return conversations, mended


def digests(mended: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the blocks of a conversation stream
    through one task, as a SHA-256 is sequential; only the audit is held."""
    schema = "conv_id long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sha, audit, lines = (), None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((here[0], pa.int64()), ("".join(audit), pa.string()), (sha.hexdigest(), pa.string()))],
                                              ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, edits, roles, texts in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if (conv,) != here:
                    if here:
                        yield row()
                    here, sha, audit, lines = (conv,), hashlib.sha256(), [], 0
                audit.append(edits)
                for r, t in zip(roles, texts, strict=True):
                    sha.update(f"{chr(10) if lines else ''}{r}:{t}".encode())
                    lines += 1
        if here:
            yield row()

    return along(mended, False).mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit"))
    out = rows.where("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The query's rows: one for each original conversation."""
    found, mended = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    digest = digests(mended).withColumnRenamed("conv_id", "digest_of")
    return every.join(found, F.col("conv").eqNullSafe(F.col("conv_id")), "left").join(digest, F.col("conv").eqNullSafe(F.col("digest_of")), "left").select(
        F.col("conv").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
