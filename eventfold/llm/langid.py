"""Operator 7: language ID by rank-order profiles.

A profile is a language's most frequent character n-grams (n = 1 to 3, words
set apart by one blank) in order of frequency. A document's own profile is
made the same way from its whole text and compared with each language's by
the out-of-place distance: per n-gram the difference of the two ranks, or the
profile length where the language lacks it. The least distance wins, ties go
to the first language in alphabetical order.

Fit: at most about ``per_language`` labelled documents of each language
(taken by a hash of the id; the bound keeps the fit small at any size). The
n-grams are counted by Spark and only the profiles reach the driver. The
profiles (300 n-grams a language) go out with the function; prediction moves
no row.

Rows: null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from. Score is one less the distance
over the largest possible. One output row per input row, any id passed
through (a null id is never held out).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm.common import by_bytes, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROFILE = 300
PER_LANGUAGE = 3000


def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool,
                       count=sys.maxunicode + 1)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (21 bits a character) and their counts; none if there is no letter."""
    table = worker_state("letters", letters)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = table[a]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    a = np.concatenate(([32], np.where(is_letter, a, 32)[keep], [32])).astype(np.int64)
    if a[-2] == 32:
        a = a[:-1]
    if a[1] == 32:
        a = a[1:]
    two = (a[:-1] << 21) | a[1:]
    return np.unique(np.concatenate((a[a != 32], two, (two[:-1] << 21) | a[2:])), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent n-grams, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:n]]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, profile: int = PROFILE, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles by language from labelled documents."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where(F.col("lang").isNotNull())
    space = 1 << 30
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(space, space * per_language // n))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = ngrams(text or "")
                found.append(pd.DataFrame({"lang": lang, "code": codes, "n": n}))
            yield pa.RecordBatch.from_pandas(pd.concat(found).groupby(["lang", "code"], as_index=False).sum(),
                                             schema=pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())]),
                                             preserve_index=False)

    grams = chosen.select("text", "lang").mapInArrow(count, "lang string, code long, n long") \
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = grams.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile).toPandas()
    return {lang: g.sort_values("rank")["code"].to_numpy(dtype=np.int64) for lang, g in top.groupby("lang")}


class Profiles:
    """The languages' ranks of each n-gram, for comparing one document with all."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]).astype(np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        own = ranked(*ngrams(text), self.size)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        k = int(away.argmin())
        return self.langs[k], 1.0 - float(away[k]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, keep: list[str] | None = None,
            text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) with lang_pred and score."""
    model = Profiles(profiles, size)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    # the text goes first, under a name of its own, and is dropped again
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(c) for c in keep]).alias("row"))
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [model.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    profiles = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), profiles, keep=["doc_id", "held_out"])
