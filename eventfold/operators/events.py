"""P1 type filter, A2 event counts, A3 counts as map, A11 totals, R2 anonymous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.expr import sorted_map


def event_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col("type") == "event")


def event_counts(records: DataFrame) -> DataFrame:
    """(user_id, name, n): distinct event records per customer and name.

    Expects deduplicated records. Anonymous events (NULL user) are removed
    before the shuffle; partial counts are combined map-side, so a hot
    customer costs one row per map task and name.
    """
    return (event_records(records)
            .filter(F.col("user_id").isNotNull())
            .groupBy("user_id", "name")
            .agg(F.count(F.lit(1)).alias("n")))


def anonymous_counts(records: DataFrame) -> DataFrame:
    """(name, n) over event records that belong to no customer."""
    return (event_records(records)
            .filter(F.col("user_id").isNull())
            .groupBy("name")
            .agg(F.count(F.lit(1)).alias("n")))


def events_map(counts: DataFrame) -> DataFrame:
    """(user_id, events map<name, n>, n_events) from event_counts output."""
    # A map key cannot be NULL: an event without a name is keyed "" here,
    # as the reference stores a missing name as "".
    return (counts.groupBy("user_id")
            .agg(sorted_map(F.collect_list(F.struct(F.coalesce("name", F.lit("")).alias("key"),
                                                    F.col("n").alias("value")))).alias("events"),
                 F.sum("n").alias("n_events")))
