"""J8 reconcile, U1 missing and U2 extra customers.

Profiles are compared in long form, (id, kind, key, value), with a full
outer join; maps themselves cannot be compared with ``=`` in Spark. Every
difference is a row, rather than stopping at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_long(profile: DataFrame) -> DataFrame:
    """(id, kind, key, value) from (id, attributes map, events map)."""
    a = profile.select("id", F.lit("attribute").alias("kind"),
                       F.explode("attributes").alias("key", "value"))
    e = profile.select("id", F.lit("event").alias("kind"),
                       F.explode("events").alias("key", "value"))
    return a.unionByName(e.withColumn("value", F.col("value").cast("string")))


def reconcile_long(actual_ids: DataFrame, actual: DataFrame,
                   expected_ids: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences between two long forms plus their id lists.

    status: missing_customer / extra_customer (id level, U1/U2), or for
    customers on both sides missing_key / extra_key / mismatch. Both sides
    meet in one aggregation keyed on (id, kind, key) (no join multiplies
    rows, and a customer with many keys spreads over many tasks); only the
    differences are then matched to the id-level presence.
    """
    ids = (expected_ids.select("id", F.lit(1).alias("_e"), F.lit(0).alias("_a"))
           .unionByName(actual_ids.select("id", F.lit(0).alias("_e"), F.lit(1).alias("_a")))
           .groupBy("id").agg(F.max("_e").alias("_e"), F.max("_a").alias("_a")))
    id_rows = (ids.filter((F.col("_e") == 0) | (F.col("_a") == 0))
               .select("id", F.lit("customer").alias("kind"), F.lit(None).cast("string").alias("key"),
                       F.lit(None).cast("string").alias("expected"),
                       F.lit(None).cast("string").alias("actual"),
                       F.when(F.col("_a") == 0, F.lit("missing_customer"))
                       .otherwise(F.lit("extra_customer")).alias("status")))
    common = ids.filter((F.col("_e") == 1) & (F.col("_a") == 1)).select("id")
    sides = (expected.select("id", "kind", "key", F.col("value").alias("_x"),
                             F.lit(None).cast("string").alias("_y"), F.lit(1).alias("_in_x"),
                             F.lit(0).alias("_in_y"))
             .unionByName(actual.select("id", "kind", "key", F.lit(None).cast("string").alias("_x"),
                                        F.col("value").alias("_y"), F.lit(0).alias("_in_x"),
                                        F.lit(1).alias("_in_y"))))
    met = (sides.groupBy("id", "kind", "key")
           .agg(F.max("_x").alias("expected"), F.max("_y").alias("actual"),
                F.max("_in_x").alias("_in_x"), F.max("_in_y").alias("_in_y")))
    status = (F.when(F.col("_in_y") == 0, F.lit("missing_key"))
              .when(F.col("_in_x") == 0, F.lit("extra_key"))
              .otherwise(F.lit("mismatch")))
    diffs = (met.filter((F.col("_in_x") != F.col("_in_y"))
                        | ~F.col("expected").eqNullSafe(F.col("actual")))
             .join(common, "id", "left_semi")
             .select("id", "kind", "key", "expected", "actual", status.alias("status")))
    return id_rows.unionByName(diffs)


def reconcile(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare two profile DataFrames (id, attributes, events)."""
    return reconcile_long(actual.select("id"), profile_long(actual),
                          expected.select("id"), profile_long(expected))


def digests(ids: DataFrame, long: DataFrame, buckets: int | None = None) -> DataFrame:
    """(id or bucket, n, a, b): digests of a profile's entries that no order of
    rows changes (their number and two 64-bit hash sums), combined before the
    shuffle: what moves is one short row a customer, whatever its entries."""
    entry = [F.col(c) for c in ("kind", "key", "value")]
    of = F.col("id") if buckets is None else F.pmod(F.xxhash64("id"), F.lit(buckets))
    # a sum of hashes cannot cancel equal entries as an exclusive or would; decimals do not overflow
    number = lambda seed: F.sum(F.xxhash64(F.lit(seed), *([F.col("id")] if buckets else []), *entry).cast("decimal(20,0)"))
    rows = long.select("id", *entry).unionByName(ids.select("id", *[F.lit(None).cast("string").alias(c) for c in ("kind", "key", "value")]))
    return rows.groupBy(of.alias("id")).agg(F.count(F.lit(1)).alias("n"), number(1).alias("a"), number(2).alias("b"),
                                            F.max(F.col("kind").isNull()).alias("there"))


def reconcile_by_digest(actual_ids: DataFrame, actual: DataFrame, expected_ids: DataFrame, expected: DataFrame) -> DataFrame:
    """``reconcile_long`` that opens only customers whose digests differ.

    Both sides' digests (one row a customer) meet first. Customers with equal
    ones go no further; the entries of the others are found by a semi join, to
    which a small set of ids is sent. Entries of ids that are on no id list
    never meet. Meant for sides that are stored: both are read twice.
    """
    sides = digests(expected_ids, expected).withColumn("_side", F.lit(0)).unionByName(
        digests(actual_ids, actual).withColumn("_side", F.lit(1))).where("there")
    same = F.struct("n", "a", "b")
    differing = sides.groupBy("id").agg(F.count(F.lit(1)).alias("_k"), F.min(same).alias("_x"), F.max(same).alias("_y")) \
        .where((F.col("_k") < 2) | (F.col("_x") != F.col("_y"))).select("id")
    take = lambda df: df.join(differing, "id", "left_semi").select(*df.columns)
    return reconcile_long(take(actual_ids), take(actual), take(expected_ids), take(expected))
