"""W2 attribute changelog, P12 changed-value predicate, A8 latest change.

A change is logged when an assertion's value differs from the previous
assertion of the same (customer, attribute), or when there is none. The
previous assertion is found with ``lag`` over a window.

Skew: a window partition holds every row of its key, and one customer
attribute may carry a large share of all records. So the window is keyed on
(user_id, key, bucket), where the bucket is a fixed span of the ordering
column (input bytes for arrival order). A bucket's size is bounded by the
span, whatever the key. The first row of each bucket takes its previous
value from the last row of the nearest earlier non-empty bucket: that
carry table has one row per non-empty bucket, small next to the input.
Event time has no such byte bound; ``balance="range"`` then cuts sampled,
equal-size ranges of (user_id, key, timestamp, position) instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.operators.attributes import attribute_assertions

# Default bucket spans: 256 MiB of input for arrival order, one hour for
# event-time order.
ARRIVAL_SPAN = 256 * 1024 * 1024
EVENT_TIME_SPAN = 3600


def changed(value: str = "value", old: str = "old_value"):
    """The new value is non-NULL and differs from the last logged one."""
    return F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col(old))


def _range_buckets(a: DataFrame, ordering: list, n: int | None) -> DataFrame:
    """Bucket = range partition of (user_id, key, ordering): Spark samples the
    data and cuts it into ``n`` ranges of about equal size, so a hot key's
    rows spread over many buckets in order. The partition index is frozen
    with a reliable checkpoint (range bounds come from sampling and would
    differ between recomputations)."""
    from eventfold.session import shared_dir
    spark = a.sparkSession
    shared_dir(spark, "range-buckets")           # makes sure a checkpoint dir is set
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = a.repartitionByRange(n, "user_id", "key", *ordering)
    return ranged.withColumn("_b", F.spark_partition_id().cast("bigint")).checkpoint(eager=True)


def attribute_changes(records: DataFrame, order: str = "arrival",
                      span: int | None = None, prior: DataFrame | None = None,
                      balance: str = "span", buckets: int | None = None) -> DataFrame:
    """(user_id, name, old_value, value, timestamp, position), one row per change.

    ``order="arrival"`` follows input position (the reference's trigger
    fires in arrival order); ``order="event_time"`` follows (timestamp,
    position). ``records`` should be deduplicated. ``prior`` (user_id,
    key, value) holds the last logged value of each attribute from earlier
    batches (see ``last_logged``); it precedes every row of this batch.

    ``balance="span"`` buckets by a fixed span of the ordering column (one
    shuffle; a bucket holds at most span bytes of input in arrival order,
    but any number of rows of one event-time span). ``balance="range"``
    buckets by sampled ranges (``buckets`` of them): every bucket has about
    the same size whatever the skew, at the cost of a range shuffle and a
    checkpoint.
    """
    a = attribute_assertions(records)
    if order == "arrival":
        bucket = F.floor(F.col("position") / (span or ARRIVAL_SPAN))
        ordering = [F.col("position")]
    elif order == "event_time":
        bucket = F.floor(F.col("timestamp") / (span or EVENT_TIME_SPAN))
        ordering = [F.col("timestamp"), F.col("position")]
    else:
        raise ValueError(f"order must be 'arrival' or 'event_time', not {order!r}")
    keys = ["user_id", "key", "_b"]
    order_struct = F.struct(*ordering)
    if balance == "range":
        a = _range_buckets(a, ordering, buckets)
    elif balance == "span":
        a = a.withColumn("_b", bucket.cast("bigint"))
    else:
        raise ValueError(f"balance must be 'span' or 'range', not {balance!r}")
    # Previous value inside the bucket. All assertions are shuffled once,
    # on (user_id, key, bucket).
    w = a.withColumn("_prev", F.lag("value").over(Window.partitionBy(*keys).orderBy(*ordering)))
    # Last value of each bucket: partial aggregation, one row per bucket.
    tails = a.groupBy(*keys).agg(F.max_by("value", order_struct).alias("_tail"))
    by_bucket = Window.partitionBy("user_id", "key").orderBy("_b")
    carry = (tails.withColumn("_carry", F.lag("_tail").over(by_bucket))
             .withColumn("_first", F.lag("_b").over(by_bucket).isNull()))
    if prior is not None:
        p = prior.select("user_id", "key", F.col("value").alias("_prior"))
        carry = (carry.join(p, ["user_id", "key"], "left")
                 .withColumn("_carry", F.when(F.col("_first"), F.col("_prior"))
                             .otherwise(F.col("_carry"))))
    # The windowed rows are already partitioned on the join keys, so only
    # the carry table (one row per bucket) moves.
    joined = w.join(carry.select(*keys, "_carry"), keys, "left")
    old = F.when(F.col("_prev").isNull(), F.col("_carry")).otherwise(F.col("_prev"))
    return (joined.select("user_id", F.col("key").alias("name"), old.alias("old_value"),
                          "value", "timestamp", "position")
            .filter(changed()))


def last_logged(records: DataFrame) -> DataFrame:
    """(user_id, key, value): the last asserted value of each attribute by
    arrival, which is also the last logged one (an unchanged value logs
    nothing). Input for ``attribute_changes(prior=...)``."""
    a = attribute_assertions(records)
    return (a.groupBy("user_id", "key")
            .agg(F.max_by("value", "position").alias("value")))


def changes_for(changes: DataFrame, users: DataFrame | None = None,
                user_col: str = "user_id") -> DataFrame:
    """P7 changelog reads: all changes, or those of the customers in
    ``users`` (left semi join: no id list on the driver)."""
    if users is None:
        return changes
    return changes.join(users.select(F.col(user_col).alias("user_id")).distinct(), "user_id", "left_semi")


def changes_of(records: DataFrame, users: DataFrame, user_col: str = "user_id", **options) -> DataFrame:
    """The changelog of the customers in ``users``, from deduplicated records:
    other customers' records go before the window, which is by customer."""
    return attribute_changes(changes_for(records, users, user_col), **options)


def latest_change(changes: DataFrame) -> DataFrame:
    """Newest logged change per (user_id, name), by position."""
    row = F.struct("old_value", "value", "timestamp", "position")
    return (changes.groupBy("user_id", "name")
            .agg(F.max_by(row, "position").alias("_r"))
            .select("user_id", "name", "_r.old_value", "_r.value", "_r.timestamp", "_r.position"))
