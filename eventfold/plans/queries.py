"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's parquet tables (through the records
adapter where records are needed) and runs over whole tables. Result
columns are plain (no maps) and named exactly as in plans/oracle.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions.expr import canonical_uuid, is_uuid, normalise_event_name, sorted_json
from eventfold.operators import checks, paging
from eventfold.operators.attributes import attribute_assertions, last_updated as last_updated_op
from eventfold.operators.attributes import latest_attributes as latest_op
from eventfold.operators.attributes import row_last_arrival as row_last_arrival_op
from eventfold.operators.changes import attribute_changes as changes_op
from eventfold.operators.changes import changes_of
from eventfold.operators.changes import latest_change as latest_change_op
from eventfold.operators.dedup import dedup_records
from eventfold.operators.events import anonymous_counts, event_counts as counts_op
from eventfold.operators.intervals import applied, repair as repair_changes
from eventfold.operators.merge import fold, load_state, merge_state, save_state
from eventfold.operators.observed import observed_long
from eventfold.operators.profiles import (
    event_lookup as event_lookup_op,
    profile_json as profile_json_op,
    profile_long,
    profile_text,
    profile_wide as profile_wide_op,
    profiles,
    profiles_of,
)
from eventfold.operators.reconcile import reconcile_by_digest, reconcile_long
from eventfold.operators.store import Store, store_sink
from eventfold.session import shared_dir
from eventfold.sources.ndjson import ledger, listed, read_lines, resume, stream_lines
from eventfold.sources.records import parse_lines, raw_records, read_records, records_to_ndjson
from eventfold.sources.summary import read_summary, summary_lines as summary_lines_op, write_summary
from eventfold.sources.tables import records, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values of the test tables: the event types, which the records
# adapter also uses as attribute keys.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
# Query parameters.
PAGE, PER_PAGE = 3, 25
AS_OF = 1_700_000_000
LOOKUP_NATION = 7
ERASE_SEGMENT = "AUTOMOBILE"


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# What a query needs of a record, so that the payload stays out of its shuffle.
EVENT_COLUMNS = ("type", "name", "user_id")
ATTRIBUTE_COLUMNS = ("type", "user_id", "data", "timestamp")


def deduped(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return dedup_records(records(spark, sf_dir), columns=columns)


def _text_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per R5 (named by an attributes record), maps as text."""
    return profile_text(deduped(spark, sf_dir))


@register
def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every customer of the customer table with its newest
    attributes and event counts (dedup -> fold + count -> left join)."""
    return profile_text(deduped(spark, sf_dir), table(spark, sf_dir, "customer"))


@register
def record_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 profiles: customers are those named by an attributes record."""
    return _text_profiles(spark, sf_dir)


@register
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + S7 rows: one record per id, data as JSON text with sorted keys."""
    d = deduped(spark, sf_dir)
    return d.select("id", "type", "name", "user_id", "timestamp", "position",
                    sorted_json(F.col("data")).alias("data_json"))


@register
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_op(deduped(spark, sf_dir, EVENT_COLUMNS))


@register
def anonymous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymous_counts(deduped(spark, sf_dir, EVENT_COLUMNS))


@register
def latest_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_op(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS))


@register
def latest_attributes_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same winners through row_number top-1."""
    return latest_op(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS), method="rank")


@register
def row_last_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_last_arrival_op(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS), fields=EVENT_TYPES)


@register
def profile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(deduped(spark, sf_dir), table(spark, sf_dir, "customer"))
    return profile_wide_op(p, fields=EVENT_TYPES)


@register
def attribute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_op(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS))


@register
def attribute_changes_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time order, hour buckets: the carry between buckets is exercised."""
    return changes_op(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS), order="event_time")


@register
def attribute_changes_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time order with sampled range buckets: equal-size buckets
    whatever the skew of one customer attribute."""
    return changes_op(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS), order="event_time", balance="range")


@register
def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog of every customer of one nation."""
    users = (table(spark, sf_dir, "customer").filter(F.col("c_nationkey") == LOOKUP_NATION)
             .select(F.col("c_custkey").alias("user_id")))
    return changes_of(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS), users)


@register
def latest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_change_op(changes_op(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS)))


@register
def profile_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = paging.list_profiles(_text_profiles(spark, sf_dir), PAGE, PER_PAGE)
    return rows.select("id", "attributes", "events", "n_events")


@register
def profile_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, meta = paging.list_profiles(_text_profiles(spark, sf_dir), PAGE, PER_PAGE)
    return meta


@register
def profile_page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 list reply for page 3 (25 per page): customers and meta as JSON."""
    return paging.list_reply_json(profile_json_op(profiles(deduped(spark, sf_dir))), PAGE, PER_PAGE)


@register
def profile_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset page: the 25 customers after id 50."""
    return (paging.page_after(_text_profiles(spark, sf_dir), 50, PER_PAGE)
            .select("id", "attributes", "events", "n_events"))


@register
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9/A11 and ingest totals as (metric, value) rows."""
    one = paging.record_totals(records(spark, sf_dir))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])))


@register
def last_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_updated_op(deduped(spark, sf_dir, ("type", "user_id", "timestamp")))


@register
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer events whose user is not in the customer table."""
    ev = deduped(spark, sf_dir, EVENT_COLUMNS).filter(F.col("type") == "event")
    return (checks.orphans(ev, "user_id", table(spark, sf_dir, "customer"), "c_custkey")
            .select("id", "user_id", "name"))


@register
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 over raw record ids and customer keys."""
    r = checks.duplicate_keys(records(spark, sf_dir), "id", "records")
    c = checks.duplicate_keys(table(spark, sf_dir, "customer"), "c_custkey", "customer")
    return r.unionByName(c)


def _new_customer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests derived from the customer table: an email for
    customers with a non-negative balance, created_at from the key."""
    c = table(spark, sf_dir, "customer")
    email = F.when(F.col("c_acctbal") >= 0,
                   F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
                   ).otherwise(F.lit(""))
    created = (F.col("c_custkey") * 100003).cast("string")
    return c.select(F.col("c_custkey").alias("id"),
                    F.create_map(F.lit("email"), email, F.lit("created_at"), created).alias("attributes"))


@register
def valid_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = checks.validate_new_customers(_new_customer_requests(spark, sf_dir), AS_OF)
    return v.select("id", "status", "reason",
                    F.try_element_at("accepted_attributes", F.lit("email")).alias("email"),
                    F.try_element_at("accepted_attributes", F.lit("created_at")).alias("created_at"))


@register
def customer_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1/D2 via J6: validated create requests merged into the state folded
    from the records; per attribute the newest timestamp wins."""
    v = checks.validate_new_customers(_new_customer_requests(spark, sf_dir), AS_OF)
    state, _ = merge_state(fold(records(spark, sf_dir)), checks.requests_to_records(v, AS_OF))
    return state.latest.select("user_id", "key", "value", "timestamp")


@register
def erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: event counts left after erasing one market segment's customers."""
    c = table(spark, sf_dir, "customer")
    gone = c.filter(F.col("c_mktsegment") == ERASE_SEGMENT).select(F.col("c_custkey").alias("id"))
    return checks.erase(counts_op(deduped(spark, sf_dir, EVENT_COLUMNS)), gone, "user_id").select("user_id", "name", "n")


@register
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_lines_op(profiles(deduped(spark, sf_dir)))


@register
def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_json_op(profiles(deduped(spark, sf_dir)))


@register
def customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 for every customer of one nation (semi join, no id list on the driver)."""
    ids = (table(spark, sf_dir, "customer").filter(F.col("c_nationkey") == LOOKUP_NATION)
           .select(F.col("c_custkey").alias("id")))
    return profiles_of(deduped(spark, sf_dir), ids)


@register
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored record of every id that was written twice."""
    raw = records(spark, sf_dir)
    twice = checks.duplicate_keys(raw, "id", "records").select(F.col("key").alias("id"))
    return (event_lookup_op(dedup_records(raw), twice)
            .select("id", "type", "name", "user_id", "timestamp"))


@register
def summary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 then S5: write the summary file, read it back in long form."""
    path = shared_dir(spark, "summary")
    write_summary(profiles(deduped(spark, sf_dir)), path)
    _, long, _ = read_summary(spark, path)
    return long


@register
def reconcile_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed reference fold (no dedup, anonymous as user 0,
    arrival order) against the intended profiles; every difference a row."""
    raw = records(spark, sf_dir)
    exp_ids, exp_long = profile_long(dedup_records(raw))
    act_ids, act_long = observed_long(raw)
    return reconcile_long(act_ids, act_long, exp_ids, exp_long)


@register
def reconcile_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table's profiles against the observed fold of
    records in which the event ``error`` was renamed on the way: customers
    missing and extra, keys missing and extra, and different values."""
    raw = records(spark, sf_dir)
    exp_ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    exp_long = profile_long(dedup_records(raw))[1]
    renamed = F.when(F.col("name") == "error", F.lit("fault")).otherwise(F.col("name"))
    act_ids, act_long = observed_long(raw.withColumn("name", renamed))
    return reconcile_long(act_ids, act_long, exp_ids, exp_long)


def _two_batches(spark: SparkSession, sf_dir: str):
    raw = records(spark, sf_dir)
    cut = raw.agg(F.max("position")).first()[0] // 2
    return raw.filter(F.col("position") <= cut), raw.filter(F.col("position") > cut)


def _merged(spark: SparkSession, sf_dir: str):
    """Fold batch 1, store it, merge batch 2 into the stored state."""
    b1, b2 = _two_batches(spark, sf_dir)
    path = shared_dir(spark, "state")
    table = "eventfold_records_" + path.rstrip("/").rsplit("-", 1)[-1]
    s1 = fold(b1, path, table=table)
    save_state(s1, path)
    c1 = changes_op(s1.records)
    s2, c2 = merge_state(load_state(spark, path, table=table), b2, path, table=table)
    return s2, c1.unionByName(c2)


@register
def merged_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].latest


@register
def merged_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].counts


@register
def merged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1]


def _ndjson_path(spark: SparkSession, sf_dir: str) -> str:
    """Write the adapter's records as NDJSON lines (the reader's input).
    Error events of a known user with k >= 90 are written in one of eight
    malformed ways, by k, which the strict reader must set aside (an anonymous
    record has no user_id field at all)."""
    raw = records(spark, sf_dir)
    k = F.try_element_at("data", F.lit("k")).try_cast("int")
    bad = F.coalesce((F.col("type") == "event") & (F.col("name") == "error") & F.col("user_id").isNotNull()
                     & (k >= 90), F.lit(False))
    good_line = records_to_ndjson(raw.filter(~bad))
    fields = {"id": F.col("id"), "type": F.col("type"), "name": F.col("name"),
              "user_id": F.col("user_id").cast("string"), "data": F.col("data"), "timestamp": F.col("timestamp")}

    def line(**changed) -> Column:
        return F.to_json(F.struct(*[v.alias(f) for f, v in (fields | changed).items()]))

    bad_line = raw.filter(bad).select(
        F.when(k == 91, line(id=F.array("id")))
        .when(k == 92, line(type=F.lit(7)))
        .when(k == 93, line(name=F.lit(7)))
        .when(k == 94, line(timestamp=F.col("timestamp").cast("string")))
        .when(k == 95, line(data=F.create_map(F.lit("k"), k)))
        .when(k == 96, F.regexp_replace(line(), r"\}$", ""))
        .when(k == 97, F.concat(F.lit("["), line(), F.lit("]")))
        .otherwise(line(user_id=F.col("user_id"))).alias("value"))
    path = shared_dir(spark, "ndjson")
    # One file per task slot, as a distributed writer of the input would
    # leave it; the reader then works on as many splits.
    try:
        slots = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext under Spark Connect
        slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    good_line.unionByName(bad_line).repartition(slots).write.text(path)
    return path


@register
def ndjson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S3 + P2: read the written lines back; valid records only."""
    valid, _ = read_records(spark, _ndjson_path(spark, sf_dir))
    return valid.select("id", "type", "name", "user_id", "timestamp",
                        sorted_json(F.col("data")).alias("data_json"))


@register
def ndjson_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = read_records(spark, _ndjson_path(spark, sf_dir))
    # the id also where the line is no JSON
    return bad.select(F.regexp_extract("value", '"(e-[0-9]+)"', 1).alias("id"), "reason")


@register
def ndjson_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 before user routing: every well-typed record as its text has it."""
    raw, _ = raw_records(read_lines(spark, _ndjson_path(spark, sf_dir)))
    return raw.select("id", "type", "name", "user_id", "timestamp", sorted_json(F.col("data")).alias("data_json"))


# Events rows whose records one file of ordered lines holds, which one task sorts.
ORDERED_EVENTS = 250_000


def _ordered_ndjson_path(spark: SparkSession, sf_dir: str, parts: int = 4) -> str:
    """The records as lines in order of arrival, in files whose names are in that
    order: at least ``parts``, and as many as their size needs."""
    path = shared_dir(spark, "ndjson-ordered")
    parts = max(parts, -(-table(spark, sf_dir, "events").count() // ORDERED_EVENTS))
    body = F.to_json(F.struct("id", "type", "name", F.col("user_id").cast("string").alias("user_id"), "data", "timestamp"))
    records(spark, sf_dir).repartitionByRange(parts, "position").sortWithinPartitions("position") \
        .select(body.alias("value")).write.text(path)
    return path


def _line_id() -> Column:
    return F.regexp_extract("value", '"id":"([^"]+)"', 1).alias("id")


@register
def ndjson_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte behind each line, over all files in order, in small ranges."""
    return read_lines(spark, _ordered_ndjson_path(spark, sf_dir), range_bytes=64 * 1024).select(_line_id(), "position")


@register
def ndjson_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read up to the middle byte, store the ledger, resume from it."""
    path = _ordered_ndjson_path(spark, sf_dir)
    end = sum(listed(path).values())
    reached_ = ledger(spark, path, read_lines(spark, path).where(F.col("position") <= end // 2))
    stored = shared_dir(spark, "ledger")
    reached_.write.parquet(stored)
    until = {r["source"]: r["offset"] for r in spark.read.parquet(stored).collect()}
    first = read_lines(spark, path, until=until)
    rest = resume(spark, path, spark.read.parquet(stored))
    return first.select(_line_id(), "position", F.lit(1).alias("pass")).unionByName(rest.select(_line_id(), "position", F.lit(2).alias("pass")))


@register
def uuid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids as UUIDs in each accepted form, and in a form that is none."""
    raw = dedup_records(records(spark, sf_dir), columns=("type",))
    h = F.md5(F.col("id").cast("binary"))
    plain = F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    form = F.pmod(F.col("position"), F.lit(6))
    text = (F.when(form == 0, plain).when(form == 1, F.upper(plain)).when(form == 2, F.concat(F.lit("{"), plain, F.lit("}")))
            .when(form == 3, F.concat(F.lit("urn:uuid:"), plain)).when(form == 4, h).otherwise(F.substring(plain, 1, 35)))
    return raw.select("id", text.alias("uuid")).select("id", "uuid", is_uuid(F.col("uuid")).alias("valid"), canonical_uuid(F.col("uuid")).alias("canonical"))


@register
def normalised_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event names that differ in case and blanks count as one."""
    spelt = F.when(F.col("position") % 4 == 1, F.concat(F.lit(" "), F.upper("name"))).otherwise(F.concat(F.initcap("name"), F.lit("  ")))
    d = deduped(spark, sf_dir, EVENT_COLUMNS)
    return counts_op(d.withColumn("name", normalise_event_name(spelt)))


@register
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of the event listing."""
    return paging.list_events(deduped(spark, sf_dir, ("type", "name", "user_id", "timestamp")), PAGE, PER_PAGE) \
        .select("id", "name", "user_id", "timestamp", "position")


@register
def events_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 by key: the 25 events after a position."""
    return paging.events_after(deduped(spark, sf_dir, ("type", "name", "user_id", "timestamp")), 1000, PER_PAGE) \
        .select("id", "name", "user_id", "timestamp", "position")


@register
def profile_page_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 through an index of id ranges: only the page's customers are folded."""
    d = deduped(spark, sf_dir)
    path = shared_dir(spark, "page-index")
    paging.write_page_index(last_updated_op(d).select(F.col("user_id").alias("id")), path, per_file=100)
    return paging.indexed_page(d, path, PAGE, PER_PAGE).select("id", "attributes", "events", "n_events")


@register
def reconcile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 by digests, on stored sides: equal customers are never opened."""
    raw = records(spark, sf_dir)
    path = shared_dir(spark, "reconcile")
    exp_long = profile_long(dedup_records(raw))[1]
    renamed = F.when(F.col("name") == "error", F.lit("fault")).otherwise(F.col("name"))
    act_ids, act_long = observed_long(raw.withColumn("name", renamed))
    sides = {"expected": exp_long, "actual_ids": act_ids, "actual": act_long}
    for name, df in sides.items():
        df.write.parquet(f"{path}/{name}")
    stored = {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in sides.items()}
    exp_ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return reconcile_by_digest(stored["actual_ids"], stored["actual"], exp_ids, stored["expected"])


@register
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key violation of the raw records, the customers and the changelog."""
    raw = records(spark, sf_dir)
    changes = changes_op(dedup_records(raw, columns=ATTRIBUTE_COLUMNS))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return checks.integrity(raw.where("type = 'event'"), customers, changes, records=raw)


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """The records merged into a store in two batches, the second with copies of the first's."""
    b1, b2 = _two_batches(spark, sf_dir)
    store = Store.create(spark, shared_dir(spark, "store"))
    store.merge(b1)
    store.merge(b2)
    return store


@register
def store_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 through the versioned store: a merge writes its batch's keys only."""
    return _store(spark, sf_dir).read("latest")


@register
def store_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _store(spark, sf_dir).profiles()
    return profile_json_op(p)


@register
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog appended by two merges, numbered without gaps."""
    return _store(spark, sf_dir).changes()


@register
def changes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes 101 to 300, by their id."""
    return _store(spark, sf_dir).changes(first=101, last=300)


@register
def erase_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: one market segment's customers erased from every part of the store;
    what is left of each part, by customer."""
    store = _store(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    store.erase(c.filter(F.col("c_mktsegment") == ERASE_SEGMENT).select(F.col("c_custkey").alias("id")))
    out = None
    for part in ("records", "latest", "counts", "customers", "logged", "changes"):
        left = store.read(part).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "user_id", "n")
        out = left if out is None else out.unionByName(left)
    return out


@register
def merged_changes_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 in event time over three batches that arrive newest first: each later
    batch repairs only the changes next to its own assertions."""
    a = attribute_assertions(deduped(spark, sf_dir, ATTRIBUTE_COLUMNS))
    path = shared_dir(spark, "event-time")
    third = F.pmod(F.floor(F.col("position") / 600), F.lit(3))
    a.withColumn("batch", F.when(third == 0, F.lit(2)).when(third == 1, F.lit(0)).otherwise(F.lit(1))).write.partitionBy("batch").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    log = None
    for batch in range(3):
        ops = repair_changes(rows.where(F.col("batch") < batch), rows.where(F.col("batch") == batch))
        changed_ = applied(spark.createDataFrame([], ops.drop("op").schema) if log is None else log, ops)
        changed_.write.parquet(f"{path}/log{batch}")
        log = spark.read.parquet(f"{path}/log{batch}")
    return log


@register
def stream_ndjson_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 + ST3 over NDJSON: several files in one micro-batch, logged in order
    of arrival by merges into the store."""
    store = Store.create(spark, shared_dir(spark, "stream-store"))
    lines = stream_lines(spark, _ordered_ndjson_path(spark, sf_dir), range_bytes=256 * 1024)
    query = parse_lines(lines)[0].drop("source").writeStream.option("checkpointLocation", shared_dir(spark, "stream-store-checkpoint")) \
        .foreachBatch(store_sink(store)).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.changes().select("change_id", "user_id", "name", "old_value", "value", "timestamp")


def _stream(name: str, mode: str, build):
    from eventfold.streaming.stream import events_stream, run_available_now

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result, _ = run_available_now(build(events_stream(spark, sf_dir)), mode, name)
        return result
    run.__name__ = name
    return run


def _stream_batches(name: str, mode: str, build):
    """The same stream in four runs over what arrived since the one before."""
    from eventfold.streaming.stream import records_stream, run_available_now, stream_folders

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folders = stream_folders(spark, name)
        for path, schema in _arrivals(spark, sf_dir, name):
            result, _ = run_available_now(build(records_stream(spark, path, schema, None)), mode, name, folders)
        return result
    run.__name__ = f"{name}_batches"
    return run


def _arrivals(spark: SparkSession, sf_dir: str, name: str):
    """The records in four deliveries to one folder, in order of arrival: yields
    the folder after each. The records are split in one pass, by Spark's own
    partitions; a delivery copies its quarter."""
    raw = records(spark, sf_dir)
    end = raw.agg(F.max("position")).first()[0]
    split, path = shared_dir(spark, f"{name}-split"), shared_dir(spark, name)
    raw.withColumn("_quarter", F.floor(F.col("position") * 4 / (end + 1)).cast("int")).write.partitionBy("_quarter").parquet(split)
    for quarter in range(4):
        spark.read.schema(raw.schema).parquet(f"{split}/_quarter={quarter}").write.mode("append").parquet(path)
        yield path, raw.schema


def _stream_upserts(name: str, keys: list[str], build):
    """The stream in four runs, in update mode into a table readable at any time."""
    from eventfold.streaming.stream import records_stream, stream_folders
    from eventfold.streaming.upserts import run_upserts

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folders = stream_folders(spark, f"upserts-{name}")
        for path, schema in _arrivals(spark, sf_dir, name):
            table = run_upserts(build(records_stream(spark, path, schema, None)), keys, name, folders)
        return table.read()
    run.__name__ = f"{name}_upserts"
    return run


def _register_streams() -> None:
    from eventfold.streaming import stream as st
    register(_stream_upserts("stream_event_counts", ["user_id", "name"], st.stream_event_counts))
    register(_stream_upserts("stream_latest_attributes", ["user_id", "key"], st.stream_latest_attributes))
    register(_stream("stream_event_counts", "complete", st.stream_event_counts))
    register(_stream("stream_latest_attributes", "complete", st.stream_latest_attributes))
    register(_stream("stream_attribute_changes", "append", st.stream_attribute_changes))
    register(_stream("stream_dedup", "append",
                     lambda r: st.stream_dedup(r).select("id", "type", "name", "user_id",
                                                         "timestamp")))
    register(_stream("stream_dedup_watermark", "append",
                     lambda r: st.stream_dedup(r, watermark="1 hour")
                     .select("id", "type", "name", "user_id", "timestamp")))
    register(_stream_batches("stream_event_counts", "complete", st.stream_event_counts))
    register(_stream_batches("stream_latest_attributes", "complete", st.stream_latest_attributes))
    register(_stream_batches("stream_attribute_changes", "append", st.stream_attribute_changes))
    register(_stream_batches("stream_dedup_watermark", "append",
                             lambda r: st.stream_dedup(r, watermark="1 hour")
                             .select("id", "type", "name", "user_id", "timestamp")))
    register(_stream_batches("stream_dedup", "append",
                             lambda r: st.stream_dedup(r).select("id", "type", "name", "user_id", "timestamp")))


_register_streams()
