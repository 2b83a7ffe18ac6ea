"""Operator 12: alignment of two tokenizers' tokens by diagonal run skipping.

A text's tokens of both tokenizers are byte ranges of space+text. Where a token
of each ends at the same byte, both are cut; between cuts lies a group. Most
groups are one token to one: there the two arrays of ends agree at a fixed
index shift. ``cuts`` probes that shift with stretches of 8, 16, 32, ... ends,
compared as bytes, and so jumps a run in a logarithmic number of steps; the
irregular group behind it is resolved end by end, which gives the next shift.

Links are all pairs of one token of each side in a group. How many documents
hold an id pair linked is counted over the corpus:

1. texts are taken in slices of bounded bytes, and aligned in chunks of fewer;
   a slice is written as one row, with its documents' figures, its distinct id
   pairs and how many of its documents hold each. What its documents hold is
   packed in the fewest bytes, and a file holds ``TOGETHER`` slices, as a reader
   takes all of a file's rows at once;
2. the pairs of all slices are summed (combined before the shuffle), and each
   A id's highest sum is marked;
3. the sums go back to the slices that hold the pair. A pair is one row a slice,
   so a pair that every document holds is no hot key. They meet in partitions of
   ``TOGETHER`` slices on average, however large the session makes its own.

So no task holds more with more input, larger files or larger partitions.

Rows: a text that is null or empty, or whose tokens' bytes of A or of B are not
those of space+text, has no tokens: zeros and an empty ``groups_sha256``. Ids
are passed through, also null and repeated ones; one row per input row. An
empty table gives no rows. Other columns are not read. Broadcast: the two
vocabularies. A group's distinct pairs are listed, not its token occurrences.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.bpe import byte_alphabet, read_text
from eventfold.llm.common import by_bytes, id_text, staged, worker_state
from eventfold.llm.packed import planes, unplane

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text bytes of a slice, and the links of a group that are listed one by one.
SLICE, SMALL = 4 << 20, 64
#: Text bytes aligned at once, and slices of a file or, on average, a partition.
CHUNK, TOGETHER = 1 << 19, 4
MARK = "▁"


class Tokens:
    """One tokenizer's ids for texts and each id's bytes."""

    def flat(self) -> None:
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def joined(self, ids: list[int]) -> bytes:
        own = self.bytes
        return b"".join([own[i] for i in ids])


class ByteLevel(Tokens):
    """A byte-level BPE file's ids. Where its ids are in the order of its merges
    and its pre-tokens are the usual ones, the same vocabulary as ranks gives
    the same ids in a third of the time (all code points are tested); a text
    of over ``LONG`` characters is left to the file's own library, whose time
    does not depend on how long a pre-token is."""

    LONG = 1 << 16
    #: The pre-tokens that the file names by its ``ByteLevel`` step (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        self.bytes = []
        for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True)):
            token = self.tokenizer.id_to_token(i) or ""
            known = all(c in alphabet for c in token)
            self.bytes.append(bytes(alphabet[c] for c in token) if known else token.encode())
        self.flat()
        self.ranks = self.by_rank(json.loads(spec))

    def by_rank(self, spec: dict):
        import tiktoken
        model, step = spec["model"], spec["pre_tokenizer"] or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        usual = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") \
            and not spec["normalizer"] and not model.get("ignore_merges")
        if not usual or [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(model["vocab"]) != 256 + len(merged):
            return None
        return tiktoken.Encoding("byte level", pat_str=self.PATTERN, mergeable_ranks={self.bytes[i]: i for i in model["vocab"].values()}, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranks and max(map(len, texts), default=0) <= self.LONG:
            return [self.ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Tokens):
    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                      else self.model.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.model.get_piece_size())]
        self.flat()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def run_length(a: bytes, b: bytes, i: int, j: int, most: int) -> int:
    """How many ends agree from a[i] and b[j] on (ends of 4 bytes each):
    stretches of 8, 16, 32, ... are compared; where one differs, its lowest
    differing bit tells at which end."""
    done, width = 0, 8
    while done < most:
        width = min(width, most - done)
        s, t, size = 4 * (i + done), 4 * (j + done), 4 * width
        x, y = a[s:s + size], b[t:t + size]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return done + ((differ & -differ).bit_length() - 1) // 32
        done += width
        width *= 2
    return done


def cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before each cut, for A and for B (ends as 4-byte integers)."""
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    n, m = len(list_a), len(list_b)
    runs = []  # first token of A, of B, cuts on this diagonal
    i = j = 0
    while i < n and j < m:
        x, y = list_a[i], list_b[j]
        if x == y:
            run = run_length(raw_a, raw_b, i, j, min(n - i, m - j))
        else:
            while x != y:  # both end at the same byte at last
                if x < y:
                    i += 1
                    x = list_a[i]
                else:
                    j += 1
                    y = list_b[j]
            run = 1
        runs += (i, j, run)
        i += run
        j += run
    first_a, first_b, length = np.array(runs, np.int64).reshape(-1, 3).T
    along = np.arange(1, length.sum() + 1) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(first_a, length) + along, np.repeat(first_b, length) + along


class Groups:
    """The groups of a chunk's texts, token numbers counting over all of them."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], cut: list[tuple[np.ndarray, np.ndarray]]):
        self.n_a, self.n_b, self.n = (np.array([len(x) for x in y], np.int64) for y in (ids_a, ids_b, [c[0] for c in cut]))
        empty = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate(ids_a + empty), np.concatenate(ids_b + empty)
        self.end_a = np.concatenate([c[0] for c in cut] + empty) + np.repeat(np.cumsum(self.n_a) - self.n_a, self.n)
        self.end_b = np.concatenate([c[1] for c in cut] + empty) + np.repeat(np.cumsum(self.n_b) - self.n_b, self.n)
        self.start_a, self.start_b = np.append(0, self.end_a)[:-1], np.append(0, self.end_b)[:-1]
        self.size_a, self.size_b = self.end_a - self.start_a, self.end_b - self.start_b

    def text(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text: digits from a table and
        separators laid out in numpy, A tokens of a group before its B tokens."""
        total = len(self.a) + len(self.b)
        ids, sep = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[np.arange(len(self.a)) + np.repeat(self.start_b, self.size_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(self.end_a, self.size_b)] = self.b
        sep[self.end_a + self.start_b - 1] = ord("|")
        sep[self.end_a + self.end_b - 1] = ord(";")
        digits, lengths = decimals(int(ids.max(initial=0)) + 1)
        out, size = digits[ids], lengths[ids]
        out[np.arange(total), size] = sep
        flat = out[np.arange(digits.shape[1])[None, :] <= size[:, None]].tobytes()
        byte = np.append(0, np.cumsum(size + 1))[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        return [flat[s:e - 1] if e > s else b"" for s, e in zip(byte, byte[1:], strict=False)]

    def links(self, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a * many + b, times): the distinct id pairs of each text in
        order, and how often each is linked. A large group goes by its distinct ids."""
        each = self.size_a * self.size_b
        text = np.repeat(np.arange(len(self.n)), self.n)
        few = np.flatnonzero(each <= SMALL)
        total = each[few]
        at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        g = np.repeat(few, total)
        span = (int(self.a.max(initial=0)) + 1) * many
        keys = [text[g] * span + self.a[self.start_a[g] + at // self.size_b[g]] * many + self.b[self.start_b[g] + at % self.size_b[g]]]
        large = np.flatnonzero(each > SMALL)
        times = [np.ones(len(g), np.int64)] if len(large) else []
        for x in large:
            a, na = np.unique(self.a[self.start_a[x]:self.end_a[x]], return_counts=True)
            b, nb = np.unique(self.b[self.start_b[x]:self.end_b[x]], return_counts=True)
            keys.append(text[x] * span + (a[:, None] * many + b[None, :]).ravel())
            times.append((na[:, None] * nb[None, :]).ravel())
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable") if len(large) else None
        key = key[order] if len(large) else np.sort(key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        held = np.add.reduceat(np.concatenate(times)[order], first) if len(large) else np.diff(np.append(first, len(key)))
        return key[first] // span, key[first] % span, held


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to n - 1, left-aligned with one place to spare, and their number."""
    held = worker_state("decimals", dict)
    if held.get("n", 0) < n:
        words = [str(i).encode() for i in range(n)]
        width = len(words[-1]) + 1
        held.update(n=n, digits=np.frombuffer(b"".join(w.ljust(width) for w in words), np.uint8).reshape(n, width),
                    lengths=np.array([len(w) for w in words], np.int64))
    return held["digits"], held["lengths"]


def narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on as byte planes, each as wide as the largest needs."""
    return planes(values.astype(np.min_scalar_type(int(values.max())))) if len(values) else b""


def widen(data: bytes, n: int) -> np.ndarray:
    return unplane(data, f"<u{len(data) // n}") if n else np.zeros(0, np.uint8)


def steps(places: np.ndarray) -> bytes:
    """Places as differences, which are small: each document's are in order.
    Where the next document starts, they wrap around."""
    kind = np.min_scalar_type(int(places.max(initial=0)))
    return planes(np.diff(places.astype(kind), prepend=kind.type(0))) if len(places) else b""


def unstep(data: bytes, n: int) -> np.ndarray:
    by = widen(data, n)
    return np.cumsum(by, dtype=by.dtype)


FIGURES = "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,held:int"
SLICES = f"slice long, figures array<struct<{FIGURES}>>, held binary, times binary, pairs array<bigint>, documents array<int>"


def aligned(docs: pa.RecordBatch, a: Tokens, b: Tokens, many: int, fields: list[pa.Field]) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """The figures of a chunk's documents, and their distinct pairs, one
    document after the other, with how often each is linked."""
    texts = [t or "" for t in docs.column(1).to_pylist()]
    ids_a, ids_b, cut = [], [], []
    none = np.zeros(0, np.int64)
    for first in range(0, len(texts), 64):
        some = texts[first:first + 64]
        whole = [f" {t}" for t in some]
        for text, spaced, x, y in zip(some, whole, a.ids(whole), b.ids(some), strict=True):
            own = spaced.encode()
            same = text and a.joined(x) == own and b.joined(y) == own
            x, y = (np.array(x, np.int64), np.array(y, np.int64)) if same else (none, none)
            ids_a.append(x)
            ids_b.append(y)
            cut.append(cuts(np.cumsum(a.size[x]).astype("<i4"), np.cumsum(b.size[y]).astype("<i4")) if same else (none, none))
    groups = Groups(ids_a, ids_b, cut)
    of, pair, times = groups.links(many)
    sums = np.bincount(of, weights=times, minlength=len(texts)).astype(np.int64)
    sha = [hashlib.sha256(x).hexdigest() if x else "" for x in groups.text()]
    figures = pa.StructArray.from_arrays(
        [docs.column(0), pa.array(groups.n_a), pa.array(groups.n_b), pa.array(groups.n), pa.array(sums), pa.array(sha, pa.string()),
         pa.array(np.bincount(of, minlength=len(texts)).astype(np.int32))], fields=fields)
    return figures, pair, times


def slices(docs: DataFrame, vocabulary: str, model: str, many: int, id_col: str, text_col: str) -> DataFrame:
    """Step 1. A pair is a * ``many`` + b. ``held`` are a document's pairs as places in ``pairs``, one
    document after the other."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        sources = spark.sparkContext.broadcast((read_text(vocabulary), base64.b64encode(f.read())))
    struct = pa.struct([(n, pa.string() if n == "groups_sha256" else pa.int32() if n == "held" else pa.int64())
                        for n in (x.split(":")[0] for x in FIGURES.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        made = TaskContext.get().partitionId() << 32
        a, b = worker_state(("alignment", vocabulary, model), lambda: (ByteLevel(sources.value[0]), Pieces(base64.b64decode(sources.value[1]))))
        for batch in by_bytes(batches, limit=SLICE):
            figures, pair, times = zip(*(aligned(x, a, b, many, list(struct)) for x in by_bytes(iter([batch]), limit=CHUNK)), strict=True)
            pairs, held, documents = np.unique(np.concatenate(pair), return_inverse=True, return_counts=True)
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v))
            yield pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), one(pa.concat_arrays(figures)), pa.array([steps(held)], pa.binary()),
                 pa.array([narrow(np.concatenate(times))], pa.binary()), one(pairs), one(documents.astype(np.int32))],
                ["slice", "figures", "held", "times", "pairs", "documents"])
            made += 1

    # a batch is about a slice (the last text of a batch is over its limit)
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": str(SLICE * 15 // 16), "spark.sql.parquet.columnarReaderBatchSize": "512"}
    return staged(id_text(docs, id_col, text_col).mapInArrow(run, SLICES), "alignment-slices", settings, TOGETHER)


def pair_counts(parts: DataFrame, many: int) -> DataFrame:
    """Step 2: (pair, n, best): documents that hold the pair, and whether no
    other pair of its A id is held by more."""
    held = parts.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
    sums = staged(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("n")), "alignment-pairs")
    a = F.expr(f"pair div {many}")
    highest = sums.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return sums.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the query's rows, and (a, b, n, best) of the id pairs."""
    import sentencepiece
    many = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    parts = slices(docs, vocabulary, model, many, id_col, text_col)
    pairs = staged(pair_counts(parts, many), "alignment-counts")
    meet = max(1, -(-parts.count() // TOGETHER))
    # a slice's pairs are sorted, so what comes back is found by value
    back = parts.select("slice", F.explode("pairs").alias("pair")).join(pairs, "pair").repartition(meet, "slice").groupBy("slice") \
        .agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("known")) \
        .select("slice", F.col("known.n").alias("n"), F.col("known.best").alias("best"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                figures, n, best = (batch.column(i).slice(k, 1).flatten() for i in (0, 3, 4))
                ends = np.append(0, np.cumsum(figures.field("held").to_numpy(), dtype=np.int64))
                places = unstep(batch.column(1)[k].as_py(), int(ends[-1]))
                often = widen(batch.column(2)[k].as_py(), int(ends[-1])).astype(np.int64)
                sums = []
                for values in (best.to_numpy(zero_copy_only=False).astype(np.int64), n.to_numpy(zero_copy_only=False)):
                    running = np.append(0, np.cumsum(values[places] * often)) if len(places) else np.zeros(1, np.int64)
                    sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([figures.field(i) for i in range(5)] + sums + [figures.field(5)],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = parts.drop("pairs", "documents").repartition(meet, "slice").join(back, "slice", "left").select(
        "figures", "held", "times", F.coalesce("n", F.array().cast("array<bigint>")).alias("n"), F.coalesce("best", F.array().cast("array<boolean>")).alias("best"))
    return out.mapInArrow(run, schema), pairs.select(F.expr(f"pair div {many}").alias("a"), (F.col("pair") % many).alias("b"), "n", "best")
