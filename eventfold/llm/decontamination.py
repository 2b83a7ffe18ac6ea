"""Operator 9: benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and become TF-IDF rows over their own
terms; the document frequencies are counted over all passages of the corpus.
A randomised SVD, whose products run over the rows' partitions, gives a
latent space. Every passage of every document is folded in, and the cosine
with each item passage makes candidates. A candidate counts only if the
longest common subsequence of words with the item is long: most of the item,
or a good part of it together with most of its end (the answer). Where parts
of the item have changed places, most of its runs of three words in any order
together with most of its end count as well.

A latent space of fixed rank keeps less of a passage's length the more items
a block holds. So the exact TF-IDF cosine makes candidates too, through
postings of the item passages' heavy terms: the others of a passage have a
length of at most half the least cosine, which bounds what they can add. And
a verbatim copy is found whatever stands around it: each item is looked up by
its rarest run of ``SHORTEST`` words and compared word by word. A pair's
cosine is the greater of both, 1 for a copy that only the lookup finds.

A term outside the benchmark's vocabulary adds to a passage's length with the
weight of a term seen once. So a passage whose known terms carry too little of
its length cannot reach the least cosine, and is passed over without a loss.

Benchmark items go out in blocks of about a megabyte of text, ``GROUP`` of them
at a time, which bounds what is broadcast and what the driver and a worker
hold. One group's documents are not moved; between groups the rows and their
hits so far are written to the shared folder, and the group's blocks dropped.
Terms are 64-bit hashes of words (letters, digits; lower case; in scripts
written without blanks each character is a word).

Rows: null or empty text has no passage and is clean; an item of fewer than
``SHORTEST`` words is found where all its words stand side by side, however few
(``least_words`` can demand more of an item); an item without a word is not
searched; repeated items or documents give a row each; a null id is passed through.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import by_bytes, mix, powers, prefix_hashes, staged, text_buffers, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words in a passage, and from one passage's start to the next one's.
WINDOW, STEP = 32, 16
#: Fewest words of an item that is searched by passages; shorter ones are looked up word by word.
SHORTEST = 8
RANK, OVERSAMPLE, PASSES = 256, 16, 2
COSINE = 0.35
#: Shares of an item in the common subsequence: alone, or with its end.
WHOLE, PART, END = 0.65, 0.6, 0.6
#: Words of a run, and the share of an item's runs in any order that count with its end.
RUN, RUNS = 3, 0.6
#: Bytes of text in a block, and blocks that are searched in one pass.
BLOCK_BYTES, GROUP = 1 << 20, 4
#: Scripts written without blanks between words, and the first bytes their characters have in UTF-8.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
UNSPACED_LEADS = [0xE0, 0xE1, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEF, 0xF0]
MAY_BE_UNSPACED = np.isin(np.arange(256), UNSPACED_LEADS)
#: Entries of postings that are added up at a time.
POSTINGS = 1 << 21


def word_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and each row's first word's number."""
    if column.null_count:
        column = column.fill_null("")
    column = pc.utf8_lower(column)
    data, starts = text_buffers(column)
    if MAY_BE_UNSPACED[data].any():
        data, starts = text_buffers(pc.replace_substring_regex(column.cast(pa.large_string()), f"({UNSPACED})", r" \1 "))
    return word_hashes(data, starts, word_bytes(), False)


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (as word numbers) of every passage."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][row] + nth * STEP
    return row, start, np.minimum(start + WINDOW, first[1:][row])


class Terms:
    """Numbers the benchmark's terms; len(self) stands for every other term."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[self._low(self.hashes)] = True

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << 20) - 1)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.low[self._low(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == h[maybe] if len(self.hashes) else np.zeros(0, bool)
        out[maybe[hit]] = at[hit]
        return out


def frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many of all documents' passages each term is, and the passages' number."""
    shared = docs.sparkSession.sparkContext.broadcast(terms.hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Terms(shared.value)
        total, all_ = np.zeros(len(t) + 1, dtype=np.int64), 0
        for batch in by_bytes(batches):
            h, first = words(batch.column(0))
            _, start, end = passages(first)
            all_ += len(start)
            number = t.numbers(h)
            known = np.flatnonzero(number < len(t))
            for shift in (0, STEP):  # a word is in at most two passages; those of one parity are apart
                pick = (start - first[:-1][np.searchsorted(first, start, side="right") - 1]) // STEP % 2 == shift // STEP
                s, e = start[pick], end[pick]
                at = np.searchsorted(s, known, side="right") - 1
                ok = (at >= 0) & (known < e[np.maximum(at, 0)]) if len(s) else np.zeros(len(known), bool)
                pairs = np.unique(at[ok] * (len(t) + 1) + number[known[ok]])
                total += np.bincount(pairs % (len(t) + 1), minlength=len(t) + 1)
        total[len(t)] = all_
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(terms) + 1, dtype=np.int64)
    df[got["term"]] = got["n"]
    return df[:-1], int(df[-1])


def tf_idf(number: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of one passage, each counted once, with weights of length one."""
    terms = np.unique(number[number < len(idf)])
    weight = idf[terms]
    norm = np.sqrt((weight ** 2).sum())
    return terms, (weight / norm if norm else weight).astype(np.float32)


def randomised_svd(rows: DataFrame, n_terms: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors (n_terms by at most ``rank``) of the sparse
    matrix whose rows are (terms, weights).

    Subspace iteration on random directions: each pass sends the current
    directions out, multiplies within the rows' partitions, and adds up the
    products by term; the driver only makes them orthonormal.
    """
    sc = rows.sparkSession.sparkContext
    width = min(n_terms, rank + OVERSAMPLE)
    q = np.random.Generator(np.random.Philox(seed)).standard_normal((n_terms, width)).astype(np.float32)
    if not n_terms:
        return q
    for _ in range(PASSES + 1):
        shared = sc.broadcast(q)

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            directions, total = shared.value, {}
            for batch in batches:
                for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = np.array(weights, dtype=np.float32)
                    y = w @ directions[terms]
                    for t, x in zip(terms, w, strict=True):
                        total[t] = total.get(t, 0) + x * y
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].astype("<f4").tobytes() for k in keys], pa.binary())],
                                             ["term", "product"])

        def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            sums = group.groupby("term")["product"].agg(lambda xs: sum(np.frombuffer(x, "<f4").astype(np.float64) for x in xs).astype("<f4").tobytes())
            return sums.reset_index()

        z = rows.mapInArrow(multiply, "term long, product binary").groupBy(F.pmod("term", F.lit(64))) \
            .applyInPandas(add, "term long, product binary").toPandas()
        product = np.zeros((n_terms, width), dtype=np.float32)
        if len(z):
            product[z["term"]] = np.stack([np.frombuffer(x, "<f4") for x in z["product"]])
        q = np.linalg.qr(product)[0].astype(np.float32)
    return q[:, :rank]


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences from start to end."""
    p = prefix_hashes(h)
    return mix((p[end] - p[start]) * powers(len(p))[1][start])


def spread(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that begin at ``low``: each entry's range and its place."""
    which = np.repeat(np.arange(len(low)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count - low, count)


def common_words(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of cells at a time."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in region:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Block:
    """One block of items: their words, terms, latent passages."""

    def __init__(self, ids: list, texts: list[str], least_words: int = 1):
        h, first = words(pa.array(texts, pa.string()))
        self.short = sorted((h[first[i]:first[i + 1]].tolist(), ids[i]) for i in range(len(ids)) if least_words <= first[i + 1] - first[i] < SHORTEST)
        keep = [i for i in range(len(ids)) if first[i + 1] - first[i] >= max(SHORTEST, least_words)]
        self.ids = [ids[i] for i in keep]
        self.words = [h[first[i]:first[i + 1]] for i in keep]
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        self.terms = Terms(flat)
        starts = np.concatenate(([0], np.cumsum([len(w) for w in self.words]))).astype(np.int64)
        self.item, start, end = passages(starts)
        self.at = start - starts[self.item]
        self.numbers = [self.terms.numbers(flat[s:e]) for s, e in zip(start, end, strict=True)]
        self.lists = [w.tolist() for w in self.words]
        self.whole = run_hashes(flat, starts[:-1], starts[1:])
        item, at = spread(np.zeros(len(keep), np.int64), np.diff(starts) - SHORTEST + 1)
        gram = run_hashes(flat, starts[item] + at, starts[item] + at + SHORTEST)
        _, number, often = np.unique(gram, return_inverse=True, return_counts=True)
        order = np.lexsort((at, often[number], item))
        order = order[np.searchsorted(item[order], np.arange(len(keep)))]  # each item's rarest
        order = order[np.argsort(gram[order], kind="stable")]
        self.gram, self.gram_item, self.gram_at = gram[order], item[order], at[order]

    @classmethod
    def of(cls, state: dict) -> Block:
        """A block from the plain values that were broadcast."""
        block = cls.__new__(cls)
        block.__dict__.update(state)
        block.terms = Terms(state["terms"])
        block.runs = [runs(x) for x in block.lists]
        return block

    def state(self) -> dict:
        return {**{k: self.__dict__.get(k) for k in (
            "ids", "short", "item", "at", "lists", "whole", "gram", "gram_item", "gram_at", "idf", "other", "latent", "fold",
            "key", "weight", "rest", "heavy", "heavy_at")}, "terms": self.terms.hashes}

    def learn(self, docs: DataFrame) -> None:
        df, n = frequencies(docs, self.terms)
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.01)
        self.other = float(np.log((1 + n) / 2) + 0.01)
        rows = [tf_idf(x, self.idf) for x in self.numbers]
        self.index(rows)
        spark = docs.sparkSession
        frame = spark.createDataFrame([(t.tolist(), w.tolist()) for t, w in rows], "terms array<long>, weights array<float>").repartition(8)
        v = randomised_svd(frame, len(self.terms))
        latent = np.stack([w @ v[t] for t, w in rows])
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = (latent / np.where(norm > 0, norm, 1)).astype(np.float32)
        self.fold = np.vstack([v * self.idf[:, None], np.zeros((1, v.shape[1]), np.float32)])

    def index(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The weights by term and passage, and each term's passages in which it is heavy."""
        term, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
        passage = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        order = np.lexsort((weight, passage))  # lightest first
        square = np.cumsum(weight[order].astype(np.float64) ** 2)
        first = np.searchsorted(passage[order], np.arange(len(rows)))
        below = np.sqrt(np.maximum(0, square - np.append(0, square)[first][passage[order]]))
        light = below <= COSINE / 2
        self.rest = np.zeros(len(rows))
        np.maximum.at(self.rest, passage[order][light], below[light])
        heavy = np.zeros(len(order), dtype=bool)
        heavy[order] = ~light
        order = np.lexsort((passage, term))
        self.key, self.weight = term[order] * len(rows) + passage[order], weight[order]
        self.heavy = np.flatnonzero(heavy[order])
        self.heavy_at = np.searchsorted(term[order][self.heavy], np.arange(len(self.terms) + 2))

    def exact(self, grid: np.ndarray, length: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, item passages and TF-IDF cosine of the pairs that reach ``cosine``."""
        n, idf = len(self.rest), np.append(self.idf, 0)
        count = np.diff(self.heavy_at)[grid]
        part = np.cumsum(count.sum(axis=1)) // POSTINGS
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        out = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            term = grid[x:y].reshape(-1)
            which, place = spread(self.heavy_at[term], count[x:y].reshape(-1))
            place = self.heavy[place]
            cell = which // grid.shape[1] * n + self.key[place] % n
            dot = np.bincount(cell, idf[term[which]] * self.weight[place], minlength=(y - x) * n).reshape(y - x, n)
            p, q = np.nonzero(dot >= (cosine - self.rest - 1e-5) * length[x:y, None])
            for k in range(0, len(p), 1 << 16):
                i, j = p[k:k + (1 << 16)] + x, q[k:k + (1 << 16)]
                key = grid[i] * n + j[:, None]
                place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                score = (np.where(self.key[place] == key, self.weight[place], 0) * idf[grid[i]]).sum(axis=1) / length[i]
                ok = score >= cosine
                out.append((i[ok], j[ok], score[ok]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip((none, none, np.zeros(0)), *out, strict=True))

    def copies(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Row and item of the items that stand in the rows word by word."""
        if len(h) < SHORTEST:
            return []
        at = np.arange(len(h) - SHORTEST + 1)
        gram = run_hashes(h, at, at + SHORTEST)
        low = np.searchsorted(self.gram, gram)
        at = at[self.gram[np.minimum(low, len(self.gram) - 1)] == gram]
        low, count = low[at], np.searchsorted(self.gram, gram[at], side="right") - low[at]
        size = np.array([len(x) for x in self.lists])
        out = set()
        part = np.cumsum(count) // POSTINGS
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            which, place = spread(low[x:y], count[x:y])
            item = self.gram_item[place]
            start = at[x:y][which] - self.gram_at[place]
            row = np.searchsorted(first, at[x:y][which], side="right") - 1
            ok = np.flatnonzero((start >= first[row]) & (start + size[item] <= first[row + 1]))
            ok = ok[run_hashes(h, start[ok], start[ok] + size[item[ok]]) == self.whole[item[ok]]]
            for r, i, s in zip(row[ok].tolist(), item[ok].tolist(), start[ok].tolist(), strict=True):
                if (r, i) not in out and h[s:s + len(self.lists[i])].tolist() == self.lists[i]:
                    out.add((r, i))
        return sorted(out)

    def short_copies(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, object]]:
        """Row and id of the short items whose words stand side by side in the row."""
        out = []
        for n, group in itertools.groupby(sorted(self.short, key=lambda s: len(s[0])), key=lambda s: len(s[0])):
            if len(h) < n:
                continue
            items = list(group)
            key = run_hashes(np.array([w for ws, _ in items for w in ws], np.uint64), np.arange(len(items)) * n, np.arange(1, len(items) + 1) * n)
            order = np.argsort(key, kind="stable")
            at = np.arange(len(h) - n + 1)
            gram = run_hashes(h, at, at + n)
            low = np.searchsorted(key[order], gram)
            at = at[key[order][np.minimum(low, len(key) - 1)] == gram]
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + n <= first[row + 1]
            at, row = at[inside], row[inside]
            # a run is reported once a row, wherever it stands
            _, once = np.unique(np.stack([row.astype(np.uint64), gram[at]]), axis=1, return_index=True)
            for r, s in zip(row[once].tolist(), at[once].tolist(), strict=True):
                found = h[s:s + n].tolist()
                for k in order[np.searchsorted(key[order], gram[s]):np.searchsorted(key[order], gram[s], side="right")].tolist():
                    if items[k][0] == found:
                        out.append((r, items[k][1]))
        return out

    def found(self, column: pa.Array, cosine: float) -> list[list[dict]]:
        """For each text its hits, short items included."""
        h, first = words(column)
        hits = [[{"item_id": self.ids[i], "cosine": c, "common": s} for i, (c, s) in sorted(got.items())] for got in self.search(h, first, cosine)]
        for r, i in self.short_copies(h, first):
            hits[r].append({"item_id": i, "cosine": 1.0, "common": 1.0})
        return hits

    def search(self, h: np.ndarray, first: np.ndarray, cosine: float) -> list[dict[int, tuple[float, float]]]:
        """For each text the contained items with cosine and share of common words."""
        out: list[dict[int, tuple[float, float]]] = [{} for _ in range(len(first) - 1)]
        row, start, end = passages(first)
        if not len(row) or not self.ids:
            return out
        number = self.terms.numbers(h)
        known = number < len(self.terms)
        weight = np.where(known, np.append(self.idf, 0)[number], self.other) ** 2
        sum_all = np.concatenate(([0], np.cumsum(weight, dtype=np.float64)))
        sum_known = np.concatenate(([0], np.cumsum(np.where(known, weight, 0), dtype=np.float64)))
        length2 = sum_all[end] - sum_all[start]
        # with a term counted at each occurrence the known share is too high, never too low
        known2 = sum_known[end] - sum_known[start]
        able = np.flatnonzero((known2 > 0) & (known2 >= cosine ** 2 * length2))
        hits = []
        for k in range(0, len(able), 512):
            part = able[k:k + 512]
            grid = start[part, None] + np.arange(WINDOW)
            grid = np.sort(np.where(grid < end[part, None], number[np.minimum(grid, len(number) - 1)], len(self.terms)), axis=1)
            grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = len(self.terms)  # a term counts once in a passage
            size = (np.append(self.idf, 0)[grid] ** 2).sum(axis=1) + length2[part] - known2[part]
            score = self.fold[grid].sum(axis=1) @ self.latent.T / np.sqrt(size)[:, None]
            p, q, exact = self.exact(grid, np.sqrt(size), cosine)
            score[p, q] = np.maximum(score[p, q], exact)
            p, q = np.nonzero(score >= cosine)
            hits += zip((-score[p, q]).tolist(), part[p].tolist(), q.tolist(), strict=True)
        for minus, w, p in sorted(hits):
            r, i = int(row[w]), int(self.item[p])
            if i in out[r]:
                continue
            item = self.lists[i]
            slack = STEP + len(item) // 4
            begin = max(int(first[r]), int(start[w]) - int(self.at[p]) - slack)
            region = h[begin:min(int(first[r + 1]), int(start[w]) - int(self.at[p]) + len(item) + slack)].tolist()
            share = common_words(item, region) / len(item)
            if share < PART:
                wide = h[max(int(first[r]), begin - len(item)):min(int(first[r + 1]), begin + len(region) + len(item))]
                region = wide.tolist()
                if len(self.runs[i] & runs(region)) < RUNS * len(self.runs[i]):
                    continue
            tail = item[-max(2, len(item) // 4):]
            if share >= WHOLE or common_words(tail, region) >= END * len(tail):
                out[r][i] = (float(-minus), share)
        for r, i in self.copies(h, first):
            out[r].setdefault(i, (1.0, 1.0))
        return out


def runs(words_: list[int]) -> set[tuple]:
    return set(zip(*(words_[k:] for k in range(RUN)), strict=False))


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """The items a block at a time; a block holds about BLOCK_BYTES of text."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        if rows:
            yield [r["id"] for r in rows], [r["text"] for r in rows]


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], cosine: float = COSINE, text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", least_words: int = 1) -> DataFrame:
    """The columns ``keep`` as struct ``row`` with ``hits``, an array of
    (item_id, cosine, common): the items that the document contains. Items of
    fewer than ``least_words`` words are not searched."""
    spark = docs.sparkSession
    fields = "array<struct<item_id:bigint,cosine:double,common:double>>"
    hit_type = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64())]))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(c) for c in keep]).alias("row"),
                       F.array().cast(fields).alias("hits"))
    corpus = docs.select(F.col(text_col).alias("text"))
    groups = itertools.batched(blocks(benchmark, item_col, item_text), GROUP)
    group = next(groups, None)
    while group is not None:
        shared = []
        for ids, texts in group:
            block = Block(ids, texts, least_words)
            if block.ids:
                block.learn(corpus)
            if block.ids or block.short:
                shared.append(spark.sparkContext.broadcast(block.state()))
        group = next(groups, None)
        if group is None:
            return _pass(rows, shared, cosine, hit_type).select("row", "hits") if shared else rows.select("row", "hits")
        if shared:  # another group follows: what this one found is written, so its blocks can go
            rows = staged(_pass(rows, shared, cosine, hit_type), "decontamination")
            for b in shared:
                b.destroy()
    return rows.select("row", "hits")


def _pass(rows: DataFrame, shared: list, cosine: float, hit_type: pa.DataType) -> DataFrame:
    """(text, row, hits) with the hits of the broadcast blocks added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Block.of(b.value) for b in shared]
        for batch in by_bytes(batches):
            hits = batch.column(2).to_pylist()
            for b in held:
                for r, found in enumerate(b.found(batch.column(0), cosine)):
                    hits[r] += found
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, hit_type)], ["text", "row", "hits"])

    return rows.mapInArrow(run, rows.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contained item: doc_id, item_id, cosine, common."""
    return search(docs, benchmark, ["doc_id"]).select("row.doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with their columns."""
    return search(docs, benchmark, docs.columns).where(F.size("hits") == 0).select("row.*")
