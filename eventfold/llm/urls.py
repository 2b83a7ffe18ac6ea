"""Operator 8: URL filter over a sorted digest array.

Rules are strings host + path prefix; listed sites are host names without a
path, found by a Spark job over the pages themselves: a site is listed if a
label of it, or a part of the label between hyphens, is a listed word. Spark
makes the strings' 64-bit xxhash values and sorts by them; the array is
streamed into the shared folder and handed to the executors, which memory-map
it. A batch of URLs makes all host suffixes with all path prefixes of the
lengths that occur, and one vectorised binary search probes them. A hit counts
only if the stored full string is the same, so collisions change nothing.

The array's size is that of the list, not of the pages; the driver holds one
partition of the sorted list at a time.

Rows: a null URL or one without ``://`` has an empty host and path, no rule
and the default verdict; one output row per input row, any id passed through.
No pages: no site is listed.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import worker_state
from eventfold.session import shared_dir
from eventfold.sources.ndjson import file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (verdict, rule); longest fitting rule wins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Words whose sites the list blocks where no rule fits: sales of pills, bets, adult sites, advertising, spam.
WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Seed of Spark's own xxhash64.
SEED = 42


def site_pattern(words: tuple[str, ...] = WORDS) -> str:
    """Of a host: its last label with a listed word, and all that follows it."""
    return rf"(?s)^(?:.*\.)?((?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?(?:\..*)?)\z"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), CAPITALS, SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def listed_sites(pages: DataFrame, words: tuple[str, ...] = WORDS, url_col: str = "url") -> DataFrame:
    """The list: every site (``site``) with a listed word that occurs in the pages, once."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    return pages.select(F.regexp_extract(host, site_pattern(words), 1).alias("site")).where("site <> ''").distinct()


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), seed=SEED)


#: What an index consists of: digests in order, for each its string's place and code, the strings.
PARTS = (".digests", ".places", ".strings")
PLACE = np.dtype([("at", "<i8"), ("size", "<i4"), ("code", "<i4")])


def write_index(entries: Iterable[tuple[int, str, int]], path: str) -> None:
    """The array's files at ``path``: (digest, string, code) in order of the digests, written as they come."""
    system, name = file_system(path)
    system.create_dir(os.path.dirname(name))
    digests, places, strings = (system.open_output_stream(name + part) for part in PARTS)
    at = 0
    with digests, places, strings:
        for number, key, code in entries:
            data = key.encode("utf-8", "surrogatepass")
            digests.write(np.array([number], dtype="<u8").tobytes())
            places.write(np.array([(at, len(data), code)], dtype=PLACE).tobytes())
            strings.write(data)
            at += len(data)


def mapped(path: str, dtype: object) -> np.ndarray:
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)


class Index:
    """A memory-mapped index; pages are read as probes touch them."""

    def __init__(self, path: str):
        self.digests, self.places, self.strings = (mapped(path + part, dtype) for part, dtype in zip(PARTS, ("<u8", PLACE, np.uint8), strict=True))
        self.n = len(self.digests)

    def probe(self, keys: list[str]) -> list[int | None]:
        """The code of each key, None where it isn't listed."""
        out: list[int | None] = [None] * len(keys)
        if not self.n or not keys:
            return out
        wanted = np.array([digest(k) for k in keys], dtype="<u8")
        at = np.searchsorted(self.digests, wanted)
        hit = self.digests[np.minimum(at, self.n - 1)] == wanted
        for i in np.flatnonzero(hit):
            j = int(at[i])
            while j < self.n and self.digests[j] == wanted[i]:  # strings of one digest stand together
                place = self.places[j]
                if self.strings[place["at"]:place["at"] + place["size"]].tobytes() == keys[i].encode("utf-8", "surrogatepass"):
                    out[i] = int(place["code"])
                    break
                j += 1
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every string that could be listed for a URL: host suffixes by path prefixes."""
    if not host:
        return []
    labels = [host] + [host[i + 1:] for i, c in enumerate(host) if c == "."]
    return [label + path[:n] for label in labels for n in lengths if n <= len(path)]


def publish(spark: SparkSession, entries: DataFrame) -> str:
    """Write the index of ``entries`` (key, code) into the shared folder and
    hand it to the executors; its name there."""
    number = F.xxhash64("key")
    # signed numbers sorted as unsigned ones: the negative ones come last
    rows = entries.select(number.alias("number"), "key", "code").orderBy(F.col("number") < 0, "number")
    path = os.path.join(folder := shared_dir(spark, "urls"), name := os.path.basename(folder))
    write_index(((r[0] % (1 << 64), r[1], r[2]) for r in rows.toLocalIterator()), path)
    for part in PARTS:
        spark.sparkContext.addFile(path + part)
    return name


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, sites: DataFrame | None = None,
          default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``sites`` (a column ``site``) is the list of blocked sites, each with its
    subdomains; that of the pages' own sites with a listed word, if not given.
    """
    rules = RULES if rules is None else rules
    verdicts = ["allow", "block"]
    spark = pages.sparkSession
    ruled = spark.createDataFrame([(rule, 2 + verdicts.index(v)) for v, rule in rules], "key string, code int")
    sites = listed_sites(pages, url_col=url_col) if sites is None else sites
    named = sites.select(F.col("site").cast("string").alias("key"), F.lit(1).alias("code")).where("key <> ''")
    lengths = sorted({0, *(len(rule) - rule.index("/") for _, rule in rules)})
    name = publish(spark, ruled.unionByName(named).groupBy("key").agg(F.max("code").alias("code")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_state(("urls", name), lambda: Index(SparkFiles.get(name + PARTS[0]).removesuffix(PARTS[0])))
        for batch in batches:
            keys = [candidates(h, p, lengths) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            codes = index.probe([k for ks in keys for k in ks])
            rule: list[str | None] = []
            verdict: list[str] = []
            at = 0
            for ks in keys:
                hits = [(len(k), k, c) for k, c in zip(ks, codes[at:at + len(ks)], strict=True) if c is not None]
                at += len(ks)
                ruled = [h for h in hits if h[2] >= 2]
                if ruled:
                    best = max(ruled)
                    rule.append(best[1])
                    verdict.append(verdicts[best[2] - 2])
                else:
                    rule.append(None)
                    verdict.append("block" if hits else default)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")) \
        .select("page_id", host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def oracle() -> str:
    """The query's rows in DuckDB SQL; ``listed`` is the table of listed sites."""
    rules = ", ".join(f"('{v}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES)
    low = f"translate({{}}, '{CAPITALS}', '{SMALL}')"
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
r AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT n, page_id, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
listed AS (SELECT DISTINCT regexp_extract(host, '{site_pattern()}', 1) AS site FROM u),
suffixes AS (SELECT n, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) AS site FROM u),
b AS (SELECT DISTINCT n FROM suffixes JOIN listed USING (site) WHERE site <> ''),
f AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u, rules
      WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN b.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (n) LEFT JOIN b ON u.n = b.n"""
