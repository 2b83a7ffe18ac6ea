"""Profiles: J1/J2 customer left join counts, J4 empty default, A3/A5 maps,
P3/P4 wide projection, P5/P6 lookups, S8 JSON form.

Every per-customer input is aggregated before it is joined, so the joins
see one row per customer per side, and all sides are hash-partitioned on
the customer id (sort-merge joins without re-shuffling the aggregates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.expr import kv_join, sorted_map
from eventfold.schema import REFERENCE_FIELDS


def profile_facts(records: DataFrame) -> DataFrame:
    """One keyed aggregation for the whole profile: (user_id, kind, key, ...).

    Attribute assertions (kind 'a') and events (kind 'e') share one long
    form, so the deduplicated records are read once and shuffled once, on
    (user_id, kind, key). Per key: the R3 winner (NULL values never win),
    the event count and the newest attributes timestamp. An attributes
    record with no entries still yields a row (key NULL): it makes its
    user a customer and counts for ``last_updated``. Partial aggregation
    runs before the shuffle, so a hot customer or key costs one row per
    map task.
    """
    ts = F.coalesce("timestamp", F.lit(0))
    entry = "array<struct<key:string,value:string>>"
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"),
                            F.lit(None).cast("string").alias("value")))
    # Built-in array functions only (no lambda), so the stage stays in
    # generated code; the kind comes from the record type after inline.
    rows = (F.when((F.col("type") == "attributes") & (F.size("data") > 0),
                   F.map_entries("data").cast(entry))
            .when(F.col("type") == "attributes", none)
            .when(F.col("type") == "event",
                  F.array(F.struct(F.coalesce("name", F.lit("")).alias("key"),
                                   F.lit(None).cast("string").alias("value")))))
    long = (records.filter(F.col("user_id").isNotNull())
            .select("user_id", "type", ts.alias("timestamp"), "position", F.inline(rows))
            .select("user_id",
                    F.when(F.col("type") == "attributes", F.lit("a")).otherwise(F.lit("e")).alias("kind"),
                    "key", "value", "timestamp", "position"))
    winner_order = F.when(F.col("value").isNotNull(), F.struct("timestamp", "position"))
    return (long.groupBy("user_id", "kind", "key")
            .agg(F.max_by(F.struct("value", "timestamp"), winner_order).alias("win"),
                 F.count(F.lit(1)).alias("n"),
                 F.max("timestamp").alias("max_ts")))


def profile_long(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R5 profiles in long form, straight from ``profile_facts``:
    (ids(id), long(id, kind, key, value)) with kind 'attribute' / 'event'
    and counts as text; no map is built. For reconcile at scale."""

    facts = profile_facts(records)
    ids = (facts.filter(F.col("kind") == "a").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
           .select(F.col("user_id").alias("id")))
    long = (facts.filter(((F.col("kind") == "a") & F.col("win.value").isNotNull())
                         | (F.col("kind") == "e"))
            .select(F.col("user_id").alias("id"),
                    F.when(F.col("kind") == "a", F.lit("attribute")).otherwise(F.lit("event")).alias("kind"),
                    "key",
                    F.when(F.col("kind") == "a", F.col("win.value"))
                    .otherwise(F.col("n").cast("string")).alias("value")))
    # ``long`` may hold event rows of users who are not customers; pair it
    # with ``ids`` (reconcile_long compares entries of common ids only).
    return ids, long


def _parts(records: DataFrame, customers: DataFrame | None, customer_key: str):
    """(id, attr entries, event entries, n_events, last_updated) per customer.

    Without ``customers``, a customer exists once an attributes record
    names it (events alone create none). ``last_updated`` is the newest
    timestamp among the customer's attributes records (A10).
    """
    is_a, is_e = F.col("kind") == "a", F.col("kind") == "e"
    per_user = (profile_facts(records).groupBy("user_id").agg(
        F.collect_list(F.when(is_a & F.col("win.value").isNotNull(),
                              F.struct(F.col("key"), F.col("win.value").alias("value")))).alias("_attrs"),
        F.collect_list(F.when(is_e, F.struct(F.col("key"), F.col("n").alias("value")))).alias("_events"),
        F.sum(F.when(is_e, F.col("n"))).alias("n_events"),
        F.max(F.when(is_a, F.col("max_ts"))).alias("last_updated"),
        F.max(is_a.cast("int")).alias("_customer"))
        .withColumnRenamed("user_id", "id"))
    if customers is None:
        out = per_user.filter(F.col("_customer") == 1)
    else:
        out = (customers.select(F.col(customer_key).cast("bigint").alias("id"))
               .join(per_user, "id", "left"))
    return out.select(
        "id",
        F.coalesce("_attrs", F.array().cast("array<struct<key:string,value:string>>")).alias("_attrs"),
        F.coalesce("_events", F.array().cast("array<struct<key:string,value:bigint>>")).alias("_events"),
        F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"),
        F.col("last_updated").cast("bigint").alias("last_updated"))


def profiles(records: DataFrame, customers: DataFrame | None = None,
             customer_key: str = "c_custkey") -> DataFrame:
    """(id, attributes map, events map, n_events, last_updated).

    ``records`` must be deduplicated (``dedup_records``).
    """
    p = _parts(records, customers, customer_key)
    return p.select("id", sorted_map(F.col("_attrs")).alias("attributes"),
                    sorted_map(F.col("_events")).alias("events"), "n_events", "last_updated")


def profile_text(records: DataFrame, customers: DataFrame | None = None,
                 customer_key: str = "c_custkey") -> DataFrame:
    """Profiles with both maps written as 'k=v,...' in key order (plain columns)."""
    p = _parts(records, customers, customer_key)
    return p.select("id", kv_join(F.col("_attrs")).alias("attributes"),
                    kv_join(F.col("_events")).alias("events"), "n_events", "last_updated")


def profile_wide(profile: DataFrame, fields=REFERENCE_FIELDS) -> DataFrame:
    """Fixed attribute columns, '' where absent, plus the event total."""
    cols = [F.coalesce(F.try_element_at("attributes", F.lit(f)), F.lit("")).alias(f)
            for f in fields]
    return profile.select("id", *cols, "n_events")


def profile_json(profile: DataFrame) -> DataFrame:
    """One JSON object per customer: id, attributes, events, last_updated."""
    body = F.struct("id", "attributes", "events",
                    F.coalesce("last_updated", F.lit(0)).alias("last_updated"))
    return profile.select("id", F.to_json(body).alias("json"))


def customer_lookup(profile: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """P5 for many ids: left semi join (no row multiplication, no ids through the driver)."""
    return profile.join(ids.select(F.col(id_col).alias("id")), "id", "left_semi")


def profiles_of(records: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """P5 from deduplicated records: profile text of the given customers alone.
    Other customers' records go by a semi join below the fold."""
    keys = ids.select(F.col(id_col).alias("user_id")).distinct()
    return profile_text(records.join(keys, "user_id", "left_semi").select(*records.columns))


def event_lookup(records: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Event records by id (id, type, name, user_id, data, timestamp)."""
    return (records.join(ids.select(F.col(id_col).alias("id")), "id", "left_semi")
            .select("id", "type", "name", "user_id", "data", "timestamp"))
