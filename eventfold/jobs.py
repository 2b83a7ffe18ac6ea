"""End-to-end batch jobs: ingest NDJSON records, verify profiles against a summary.

    python -m eventfold.jobs ingest  <ndjson path> <out dir> [--customers <parquet>]
    python -m eventfold.jobs more    <ndjson path> <out dir>
    python -m eventfold.jobs verify  <out dir> <summary path>

``ingest`` and ``more`` take --uuid (ids must be UUIDs), --canonical-ids and
--normalise-names.

``ingest`` writes under <out dir>:
    decoded/      every line, decoded once                 (S1)
    quarantine/   malformed lines with a reason            (S3)
    records/      deduplicated records, by load / date     (S7)
    profiles/     one JSON object per customer             (S8)
    summary/      expected-summary text, ids as strings    (S6)
    changes/      attribute changelog                      (W2)
``verify`` reads a summary (S5), compares it with <out dir>/profiles and
writes every difference to <out dir>/differences (J8), returning their count.

``more`` reads only what was added to the input since its last run and merges it
into the versioned store <out dir>/store (``operators.store``).

Each output is one Spark write. The text is scanned and parsed once; the records
come from the decoded lines, and every later output from the stored records, so
none repeats the parse or the dedup shuffle. Paths may be on any shared file system.
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventfold.operators.changes import attribute_changes
from eventfold.operators.dedup import dedup_records
from eventfold.operators.profiles import profiles
from eventfold.operators.reconcile import reconcile_by_digest
from eventfold.operators.store import Store
from eventfold.sources.ndjson import LEDGER, PACKED, exists, ledger, read_lines, resume
from eventfold.sources.records import decode_lines, lines_with_positions, split_decoded
from eventfold.sources.sinks import store_records, write_profiles_json
from eventfold.sources.summary import read_summary, summary_long, write_summary


def ingest(spark: SparkSession, input_path: str, out_dir: str,
           customers: DataFrame | None = None, by_date: bool = True, require_uuid: bool = False,
           canonical_ids: bool = False, normalise_names: bool = False) -> dict:
    """Run the whole ingest; returns counts of valid and quarantined lines.

    The text is read and parsed once, into a table of decoded lines, whose
    write counts them as it goes (``DataFrame.observe``); every output reads it.
    """
    out = out_dir.rstrip("/")
    seen = Observation("ingest")
    packed = PACKED.search(input_path) is not None
    lines = lines_with_positions(spark, input_path) if packed else read_lines(spark, input_path)
    decoded = decode_lines(lines.select("value", "source", "position"), require_uuid, canonical_ids, normalise_names)
    bad = F.col("reason").isNotNull()
    decoded.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("quarantined"),
                    F.count_if(~bad & F.col("user_id").isNull()).alias("anonymous")) \
        .write.mode("overwrite").parquet(f"{out}/decoded")
    valid, quarantine = split_decoded(spark.read.schema(decoded.schema).parquet(f"{out}/decoded"))
    quarantine.write.mode("overwrite").parquet(f"{out}/quarantine")
    stored = store_records(dedup_records(valid.drop("source")), f"{out}/records",
                           load=uuid.uuid4().hex, mode="overwrite", by_date=by_date)
    write_profiles_json(profiles(stored, customers), f"{out}/profiles")
    # the stored profiles are the summary's input, so that they are folded once
    write_summary(read_profiles_json(spark, f"{out}/profiles"), f"{out}/summary")
    attribute_changes(stored).write.mode("overwrite").parquet(f"{out}/changes")
    return {"records": stored.count(), "quarantined": seen.get["quarantined"]}


def ingest_more(spark: SparkSession, input_path: str, out_dir: str, require_uuid: bool = False,
                canonical_ids: bool = False, normalise_names: bool = False) -> dict:
    """Incremental ingest: read what the ledger has not seen, merge it into the
    store under <out dir>/store, and append to the ledger. Each run is one merge
    numbered by the ledger's entries, so a run that failed half-way repeats
    without counting twice."""
    out = out_dir.rstrip("/")
    if not exists(f"{out}/store/versions"):
        Store.create(spark, f"{out}/store")
    store = Store(spark, f"{out}/store")
    # the new ledger names the bytes that this run reads: files may grow meanwhile
    upto, path = ledger(spark, input_path), f"{out}/ledger"
    until = {r["source"]: r["offset"] for r in upto.collect()}
    run, seen = 0, spark.createDataFrame([], LEDGER)
    if exists(path):
        every = spark.read.schema(f"{LEDGER}, run bigint").parquet(path)
        run = every.agg(F.max("run")).first()[0] + 1
        seen = every.where(F.col("run") == run - 1)
    # arrival goes on behind all that was stored, also where a new file sorts first or one was replaced
    base = store.versions.read("records").agg(F.max("position")).first()[0] or 0
    lines = resume(spark, input_path, seen, until, base)
    decoded = decode_lines(lines.select("value", "source", "position"), require_uuid, canonical_ids, normalise_names)
    decoded.write.mode("overwrite").parquet(f"{out}/decoded/run={run}")
    valid, quarantine = split_decoded(spark.read.schema(decoded.schema).parquet(f"{out}/decoded/run={run}"))
    version = store.merge(valid.drop("source"), run)
    upto.withColumn("run", F.lit(run).cast("bigint")).coalesce(1).write.mode("append").parquet(path)
    return {"version": version.number, "quarantined": quarantine.count()}


def read_profiles_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "id bigint, attributes map<string,string>, events map<string,bigint>, last_updated bigint"
    return spark.read.schema(schema).json(path)


def verify(spark: SparkSession, out_dir: str, summary_path: str) -> int:
    """Reconcile served profiles with an expected summary; 0 means they match.

    The stored profiles are compared as they are, not as summary text, so a
    value that the text form cannot hold (one with a comma) is a difference.
    An integer-valued attribute counts as an event, as the summary format
    reads it. Each summary line that cannot be read is a failure too.
    """
    out = out_dir.rstrip("/")
    exp_ids, exp_long, bad = read_summary(spark, summary_path)
    profiles_ = read_profiles_json(spark, f"{out}/profiles")
    act_ids, act_long = profiles_.select("id"), summary_long(profiles_)
    diffs = reconcile_by_digest(act_ids, act_long, exp_ids, exp_long)
    diffs.write.mode("overwrite").parquet(f"{out}/differences")
    bad.write.mode("overwrite").parquet(f"{out}/summary-quarantine")
    return spark.read.parquet(f"{out}/differences").count() + spark.read.parquet(f"{out}/summary-quarantine").count()


def main(argv: list[str] | None = None) -> int:
    from eventfold.session import get_spark
    p = argparse.ArgumentParser(prog="eventfold.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    a, m = sub.add_parser("ingest"), sub.add_parser("more")
    for x in (a, m):
        x.add_argument("input")
        x.add_argument("out")
        x.add_argument("--uuid", action="store_true", help="ids must be UUIDs")
        x.add_argument("--canonical-ids", action="store_true", help="UUIDs as 32 hex digits")
        x.add_argument("--normalise-names", action="store_true", help="event names in lower case without spaces")
    a.add_argument("--customers", help="parquet with a c_custkey column (optional)")
    v = sub.add_parser("verify")
    v.add_argument("out")
    v.add_argument("summary")
    args = p.parse_args(argv)
    spark = get_spark()
    if args.cmd == "ingest":
        cust = spark.read.parquet(args.customers) if args.customers else None
        print(ingest(spark, args.input, args.out, cust, require_uuid=args.uuid, canonical_ids=args.canonical_ids,
                     normalise_names=args.normalise_names))
        return 0
    if args.cmd == "more":
        print(ingest_more(spark, args.input, args.out, args.uuid, args.canonical_ids, args.normalise_names))
        return 0
    n = verify(spark, args.out, args.summary)
    print(f"{n} differences" if n else "profiles match the summary")
    return 1 if n else 0


if __name__ == "__main__":
    raise SystemExit(main())

