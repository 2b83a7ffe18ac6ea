"""W2 in event time, batch by batch: a late assertion repairs its neighbours only.

In event time a change compares an assertion with the one just before it in
(timestamp, position). An assertion that arrives later but lies earlier changes
the old value of the one behind it, and may make or unmake a change there.
``repair`` finds these rows and gives the retractions and additions; merged in
any batch order, the changelog is that of one batch.

Window partitions are (user_id, key, bucket) with buckets of a fixed span of
time. Only buckets that a new assertion falls into are read whole, and of the
other buckets of the touched attributes only the first and last rows, combined
before the shuffle; a table with one row a bucket carries values across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.operators.changes import EVENT_TIME_SPAN, changed
from eventfold.schema import CHANGE

KEY = ["user_id", "key"]
ROW = ["user_id", "key", "value", "timestamp", "position"]


def repair(old: DataFrame, new: DataFrame, span: int = EVENT_TIME_SPAN) -> DataFrame:
    """(op, user_id, name, old_value, value, timestamp, position): ``-`` for a
    logged change that no longer holds, ``+`` for one that now does.

    ``old`` and ``new`` are assertions (``attribute_assertions``) of records
    that occur in one of them only.
    """
    bucket = F.floor(F.col("timestamp") / span).cast("bigint").alias("_b")
    new = new.select(*ROW, bucket)
    touched = new.select(*KEY, "_b").distinct()
    old = old.select(*ROW, bucket).join(new.select(*KEY).distinct(), KEY, "left_semi").select(*ROW, "_b")
    at = F.struct("timestamp", "position")
    # Each bucket's first and last row; those of new rows are in touched buckets.
    whole = F.struct("timestamp", "position", "value")
    ends = old.groupBy(*KEY, "_b").agg(F.min_by(whole, at).alias("_head"), F.max_by(whole, at).alias("_last_old"))
    tails = new.groupBy(*KEY, "_b").agg(F.max_by(whole, at).alias("_last_new"))
    buckets = ends.join(tails, [*KEY, "_b"], "full")
    by_bucket = Window.partitionBy(*KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # struct comparison is by timestamp, then position: the later of the two last rows
    last = F.greatest("_last_old", "_last_new")
    carry = buckets.withColumn("_carry_old", F.last("_last_old", ignorenulls=True).over(by_bucket)["value"]) \
        .withColumn("_carry_all", F.last(last, ignorenulls=True).over(by_bucket)["value"])
    inside = old.join(touched, [*KEY, "_b"], "left_semi").select(*ROW, "_b", F.lit(False).alias("_new")) \
        .unionByName(new.select(*ROW, "_b", F.lit(True).alias("_new")))
    heads = carry.where("_head is not null").join(touched, [*KEY, "_b"], "left_anti") \
        .select(*KEY, F.col("_head.value").alias("value"), F.col("_head.timestamp").alias("timestamp"),
                F.col("_head.position").alias("position"), "_b", F.lit(False).alias("_new"))
    order = Window.partitionBy(*KEY, "_b").orderBy("timestamp", "position")
    older = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = inside.unionByName(heads) \
        .withColumn("_prev_all", F.lag("value").over(order)) \
        .withColumn("_prev_old", F.last(F.when(~F.col("_new"), F.col("value")), ignorenulls=True).over(older)) \
        .join(carry.select(*KEY, "_b", "_carry_old", "_carry_all"), [*KEY, "_b"])
    rows = rows.withColumn("_was", F.coalesce("_prev_old", "_carry_old")).withColumn("_is", F.coalesce("_prev_all", "_carry_all"))
    moved = F.col("_new") | ~F.col("_was").eqNullSafe(F.col("_is"))
    ops = F.array(F.when(~F.col("_new") & changed("value", "_was"), F.struct(F.lit("-").alias("op"), F.col("_was").alias("old_value"))),
                  F.when(changed("value", "_is"), F.struct(F.lit("+").alias("op"), F.col("_is").alias("old_value"))))
    return rows.where(moved).select("user_id", F.col("key").alias("name"), "value", "timestamp", "position", F.explode(ops).alias("_o")) \
        .where("_o is not null").select("_o.op", "user_id", "name", "_o.old_value", "value", "timestamp", "position")


def applied(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """A changelog after retractions and additions."""
    names = CHANGE.fieldNames()
    key = ["user_id", "name", "timestamp", "position"]
    kept = changes.select(*names).join(ops.where("op = '-'").select(*key), key, "left_anti").select(*names)
    return kept.unionByName(ops.where("op = '+'").select(*names))
