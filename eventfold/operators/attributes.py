"""Attribute folding: A4 latest value, A5 map, A6 row-last-arrival, A10 last_updated.

R3: per (customer, attribute) the value with the greatest ``timestamp``
wins; ``position`` (arrival order) breaks ties. Arrival order itself does
not matter, so any partitioning or input order gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.expr import sorted_map
from eventfold.schema import REFERENCE_FIELDS


def attribute_records(records: DataFrame) -> DataFrame:
    return records.filter((F.col("type") == "attributes") & F.col("user_id").isNotNull())


def attribute_assertions(records: DataFrame, with_id: bool = False) -> DataFrame:
    """Long form (user_id, key, value, timestamp, position), one row per map entry.

    A missing timestamp counts as 0. A NULL value asserts nothing and is
    dropped; an empty string is a value. ``with_id`` keeps the record id
    as ``record_id`` (the tie-break of streams, which have no position).
    """
    extra = [F.col("id").alias("record_id")] if with_id else []
    return (attribute_records(records)
            .select("user_id", F.explode("data").alias("key", "value"),
                    F.coalesce("timestamp", F.lit(0)).alias("timestamp"), "position", *extra)
            .filter(F.col("value").isNotNull()))


def latest_attributes(records: DataFrame, method: str = "max_by") -> DataFrame:
    """(user_id, key, value, timestamp, position): the winning assertion per key.

    ``method="max_by"``: one aggregation with a partial step before the
    shuffle (each map task sends at most one row per key).
    ``method="rank"``: ``row_number`` top-1, planned with a partial
    WindowGroupLimit before the shuffle.
    """
    a = attribute_assertions(records)
    if method == "rank":
        w = Window.partitionBy("user_id", "key").orderBy(F.desc("timestamp"), F.desc("position"))
        return (a.withColumn("_rn", F.row_number().over(w))
                .filter(F.col("_rn") == 1).drop("_rn"))
    order = F.struct("timestamp", "position")
    win = F.max_by(F.struct("value", "timestamp", "position"), order).alias("_w")
    return (a.groupBy("user_id", "key").agg(win)
            .select("user_id", "key", "_w.value", "_w.timestamp", "_w.position"))


def attributes_map(latest: DataFrame) -> DataFrame:
    """(user_id, attributes map, last_updated) from latest_attributes output."""
    entries = F.collect_list(F.struct(F.col("key"), F.col("value")))
    return (latest.groupBy("user_id")
            .agg(sorted_map(entries).alias("attributes"),
                 F.max("timestamp").alias("last_updated")))


def last_updated(records: DataFrame) -> DataFrame:
    """(user_id, last_updated): newest timestamp among a customer's attributes records."""
    return (attribute_records(records)
            .groupBy("user_id")
            .agg(F.max(F.coalesce("timestamp", F.lit(0))).alias("last_updated")))


def row_last_arrival(records: DataFrame, fields=REFERENCE_FIELDS) -> DataFrame:
    """Observed reference fold: the last attributes record to arrive sets every
    field; a key it lacks becomes ''. One row per customer.
    """
    row = F.struct(*[F.coalesce(F.try_element_at("data", F.lit(f)), F.lit("")).alias(f)
                   for f in fields])
    return (attribute_records(records)
            .groupBy("user_id")
            .agg(F.max_by(row, "position").alias("_r"))
            .select("user_id", *[F.col(f"_r.{f}").alias(f) for f in fields]))


def attribute_state(records: DataFrame, mode: str = "latest", fields=REFERENCE_FIELDS) -> DataFrame:
    """Attribute state per customer: ``mode="latest"`` is R3 (long form,
    one row per attribute); ``mode="row_last_arrival"`` is the reference's
    observed whole-row overwrite on ``fields`` (one row per customer)."""
    if mode == "latest":
        return latest_attributes(records)
    if mode == "row_last_arrival":
        return row_last_arrival(records, fields)
    raise ValueError(f"mode must be 'latest' or 'row_last_arrival', not {mode!r}")
