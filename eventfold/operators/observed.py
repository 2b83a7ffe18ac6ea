"""The reference's observed fold, for reconciling against the intended one.

Observed: records are not deduplicated before counting, an anonymous event
is stored under user 0 (Go's zero value), and each attribute takes the
value that arrived last rather than the newest by timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.expr import sorted_map
from eventfold.operators.attributes import attribute_assertions


def observed_long(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids(id), long(id, kind, key, value)) of the observed fold; one
    aggregation on (user_id, kind, key), no maps."""
    a = (attribute_assertions(records)
         .select("user_id", F.lit("attribute").alias("kind"), "key", "value", "position"))
    e = (records.filter(F.col("type") == "event")
         .select(F.coalesce("user_id", F.lit(0).cast("bigint")).alias("user_id"),
                 F.lit("event").alias("kind"), F.coalesce("name", F.lit("")).alias("key"),
                 F.lit(None).cast("string").alias("value"), "position"))
    facts = (a.unionByName(e).groupBy("user_id", "kind", "key")
             .agg(F.max_by("value", "position").alias("last"), F.count(F.lit(1)).alias("n")))
    ids = (records.filter((F.col("type") == "attributes") & F.col("user_id").isNotNull())
           .groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
           .select(F.col("user_id").alias("id")))
    long = facts.select(F.col("user_id").alias("id"), "kind", "key",
                        F.when(F.col("kind") == "attribute", F.col("last"))
                        .otherwise(F.col("n").cast("string")).alias("value"))
    # ``long`` may hold event rows of users who are not customers; pair it
    # with ``ids`` (reconcile_long compares entries of common ids only).
    return ids, long


def observed_profiles(records: DataFrame) -> DataFrame:
    """(id, attributes map, events map) as the reference would serve them."""
    a = attribute_assertions(records)
    attrs = (a.groupBy("user_id", "key").agg(F.max_by("value", "position").alias("value"))
             .groupBy("user_id")
             .agg(sorted_map(F.collect_list(F.struct("key", "value"))).alias("attributes")))
    ev = (records.filter(F.col("type") == "event")
          .withColumn("user_id", F.coalesce("user_id", F.lit(0).cast("bigint")))
          .groupBy("user_id", F.coalesce("name", F.lit("")).alias("key"))
          .agg(F.count(F.lit(1)).alias("value"))
          .groupBy("user_id")
          .agg(sorted_map(F.collect_list(F.struct("key", "value"))).alias("events")))
    # Customers exist once an attributes record names them.
    return (attrs.join(ev, "user_id", "left")
            .select(F.col("user_id").alias("id"), "attributes",
                    F.coalesce("events", F.create_map().cast("map<string,bigint>")).alias("events")))
