"""Operator 3: personal data by bootstrapped contextual extraction.

Seeds are the spans that four fixed patterns find (email, ip, card, phone).
The words around a seed make a lexical pattern (two words before; last word
before and first one after; a label before a colon or equals sign). Every
identifier-like run of characters of any length between the seeds is a
candidate and has patterns of the same forms. Patterns and instances form a
graph, which Spark scores in rounds:

* a pattern's confidence for a kind is the mean score of the distinct
  instances it extracts, lowered for patterns with few of them;
* an unseen instance's score is the noisy-or of its patterns' confidences.

In the end the occurrences that a confident pattern extracts, and that have
the loose shape of the pattern's kind, are added as spans. Seed spans stay.

A graph's nodes and edges stay distributed; sums over a frequent pattern are
combined before they are shuffled. Candidates are split from the text in one
pass; only spans and contexts leave it.

Rows: null text counts as empty and has no span; one output row per input row
whatever the id; an added span never overlaps a seed or another added one.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import by_bytes, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs and the look-behind find the same matches without trying a run again from its middle.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Candidates: runs of digits and what parts or masks them; what ends an address.
RUN = re.compile(r"[0-9(+][0-9xX*().+/\x20-]*[0-9xX*]")
STOP = frozenset(" \t\n\r\f\v()[]{}<>\"',;:!?=|@")
WORD = re.compile(r"\w+")
#: A longer context word is known by its digest.
LONG_WORD = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # no later match can hold this sign, and none before it is open
            at = text.find("@", done)
    return out


def seeds(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (kind, start, end), by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape(token: str) -> int:
    """Kinds whose loose shape a token has, as bits."""
    digits = sum("0" <= c <= "9" for c in token)
    bits = 0
    if "@" in token and 0 < token.index("@") < len(token) - 1:
        bits |= 1
    if token.count(".") == 3 and digits >= 4 and all(c in "0123456789.x*X" for c in token):
        bits |= 2
    if 12 <= digits <= 19 and all(c in "0123456789 -xX*" for c in token):
        bits |= 4
    if 7 <= digits <= 15 and all(c in "0123456789 -.()/+" for c in token):
        bits |= 8
    return bits


def candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Identifier-like runs of text[start:end], which holds no base span."""
    out = []
    for m in RUN.finditer(text, start, end):
        s, e = m.span()
        if text[s] == "(" and ")" not in m[0]:
            s += 1
        out.append((s, e))
    done, at = start, text.find("@", start, end)
    while at >= 0:
        s = e = at
        while s > done and text[s - 1] not in STOP:
            s -= 1
        e += 1
        while e < end and text[e] not in STOP:
            e += 1
        while e > at + 1 and text[e - 1] == ".":
            e -= 1
        if s < at < e - 1:
            out = [x for x in out if x[1] <= s or x[0] >= e]
            out.append((s, e))
        done = max(e, at + 1)
        at = text.find("@", done, end)
    return sorted(out)


def contexts(text: str, words: list[tuple[int, int]], starts: list[int], start: int, end: int) -> list[str]:
    """The lexical patterns of an occurrence: the two words before; the last one
    before and the first one after; the label before a colon or equals sign."""
    def word(k: int) -> str:
        w = DIGIT.sub("0", text[words[k][0]:words[k][1]].lower())
        return w if len(w) <= LONG_WORD else hashlib.sha256(w.encode()).hexdigest()

    k = bisect.bisect_left(starts, start)  # words of the occurrence itself start in it
    if k and words[k - 1][1] > start:
        k -= 1
    after = bisect.bisect_left(starts, end)
    out = []
    if k >= 2:
        out.append(f"b {word(k - 2)} {word(k - 1)}")
    if k and after < len(words):
        out.append(f"a {word(k - 1)} {word(after)}")
    if k and any(c in ":=" for c in text[words[k - 1][1]:start][:8]):
        out.append(f"k {word(k - 1)}")
    return out


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Base spans, and all nodes (kind or -1, bits, instance, start, end, patterns)."""
    base = seeds(text)
    if "@" not in text and not DIGIT.search(text):
        return base, []
    found, at = [], 0
    for s, e in sorted((s, e) for _, s, e in base):
        if s > at:
            found += candidates(text, at, s)
        at = max(at, e)
    found += candidates(text, at, len(text))
    loose = [(-1, bits, s, e) for s, e in found if (bits := shape(text[s:e]))]
    every = [(k, 1 << k, s, e) for k, s, e in base] + loose
    if not every:
        return base, []
    words = [m.span() for m in WORD.finditer(text)]
    starts = [s for s, _ in words]
    return base, [(k, bits, text[s:e], s, e, contexts(text, words, starts, s, e)) for k, bits, s, e in every]


def _span(rows: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


SPANS = "array<struct<k:int,s:int,e:int>>"
NODES = "array<struct<kind:int,bits:int,inst:string,s:int,e:int,pats:array<string>>>"


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` as a struct, with base spans and occurrences."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(c) for c in keep]).alias("row"))
    schema = f"{rows.select('row').schema.simpleString()[7:-1].replace('row:', 'row ', 1)}, base {SPANS}, nodes {NODES}"
    base_t = pa.list_(pa.struct([(n, pa.int32()) for n in "kse"]))
    node_t = pa.list_(pa.struct([("kind", pa.int32()), ("bits", pa.int32()), ("inst", pa.string()), ("s", pa.int32()),
                                 ("e", pa.int32()), ("pats", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [occurrences(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([[dict(zip("kse", x, strict=True)) for x in f[0]] for f in found], base_t),
                 pa.array([[dict(zip(("kind", "bits", "inst", "s", "e", "pats"), x, strict=True)) for x in f[1]] for f in found], node_t)],
                ["row", "base", "nodes"])

    return rows.mapInArrow(run, schema)


def bootstrap(nodes: DataFrame, rounds: int = 3, least_seeds: int = 5, confident: float = 0.8) -> DataFrame:
    """Confident patterns (pat, kind) from occurrences (kind, bits, inst, pat)."""
    # an edge for each kind that an instance could be: a seed only its own
    kinds = F.array(*[F.lit(k) for k in range(len(KINDS))])
    edges = staged(nodes.select("pat", "inst", (F.col("kind") >= 0).alias("seed"), F.explode(
        F.when(F.col("kind") >= 0, F.array("kind")).otherwise(F.filter(kinds, lambda k: F.col("bits").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0))).alias("kind"))
        .distinct(), "pii-edges")
    total = edges.select("pat", "inst").distinct().groupBy("pat").agg(F.count(F.lit(1)).alias("total"))
    known = edges.select("inst", "kind", F.lit(1.0).alias("score")).where("false")
    patterns = None
    for _ in range(rounds):
        scored = edges.join(known, ["inst", "kind"], "left").withColumn(
            "score", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))))
        patterns = staged(
            scored.groupBy("pat", "kind").agg(F.sum("score").alias("good"), F.sum(F.col("seed").cast("int")).alias("seeds"))
            .where("seeds > 0").join(total, "pat")
            .withColumn("confidence", F.col("good") / (F.col("total") + F.lit(0.5))), "pii-patterns")
        known = edges.where(~F.col("seed")).join(patterns.where(F.col("seeds") >= least_seeds), ["pat", "kind"]) \
            .groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
    return patterns.where((F.col("seeds") >= least_seeds) & (F.col("confidence") >= confident)).select("pat", "kind")


def extract(docs: DataFrame, keep: list[str], text_col: str = "text", rounds: int = 3, least_seeds: int = 5,
            confident: float = 0.8) -> DataFrame:
    """The columns ``keep`` (as struct ``row``) with base and all spans as arrays of (k, s, e)."""
    found = staged(scan(docs, keep, text_col).withColumn("rid", F.monotonically_increasing_id()), "pii-found")
    flat = found.select("rid", F.explode("nodes").alias("n")).select("rid", "n.*")
    pats = flat.select("kind", "bits", "inst", F.explode("pats").alias("pat"))
    good = bootstrap(pats, rounds, least_seeds, confident)
    added = flat.where("kind < 0").select("rid", "bits", "s", "e", F.explode("pats").alias("pat")) \
        .join(good.withColumnRenamed("kind", "k"), "pat") \
        .where(F.expr("bits & shiftleft(1, k) != 0")).groupBy("rid", "s", "e").agg(F.min("k").alias("k")) \
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "s", "e"))).alias("more"))
    return found.join(added, "rid", "left").select(
        "row", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def _count(kind: int) -> Column:
    """Base spans of one kind. (A second lambda parameter, default or not, would be the array index.)"""
    return F.size(F.filter("base", lambda x: x["k"] == F.lit(kind))).cast("long")


def spans(docs: DataFrame) -> DataFrame:
    """The query's rows: base counts, digest of the base spans, all spans."""
    out = extract(docs, ["doc_id"])
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("row.doc_id", *counts, F.sha2(_span(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      _span(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets."""
    columns = docs.columns
    out = extract(docs, columns).select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            at = columns.index("text")
            texts = row.field(at).to_pylist()
            changed = []
            for text, found in zip(texts, batch.column(1).to_pylist(), strict=True):
                if found:
                    done, parts = 0, []
                    for x in sorted(found, key=lambda x: (x["s"], -x["e"])):
                        if x["s"] >= done:
                            parts += [text[done:x["s"]], f"<{KINDS[x['k']].upper()}>"]
                            done = x["e"]
                        elif x["e"] > done:
                            done = x["e"]
                    text = "".join(parts) + text[done:]
                changed.append(text)
            cols = [row.field(i) if i != at else pa.array(changed, row.field(i).type) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, columns)

    return out.mapInArrow(run, docs.schema)
