"""J7 referential check, A12 key uniqueness, P9-P11 new-customer validation, D3 erase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.expr import is_epoch_seconds


def duplicate_keys(df: DataFrame, key: str, table_name: str) -> DataFrame:
    """Keys that occur more than once: (tbl, key, n). Partial counts
    are combined before the shuffle, so a hot key costs one row per task."""
    return (df.groupBy(F.col(key).cast("string").alias("key"))
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1)
            .select(F.lit(table_name).alias("tbl"), "key", "n"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent row.

    The keys are checked first: the child's distinct keys (combined
    map-side, so a hot key is one row per task) are anti-joined with the
    parent's keys; only then are child rows matched to the orphan keys,
    a set that is usually small enough for AQE to broadcast. The large
    child table is then never shuffled by key.
    """
    keys = (child.filter(F.col(child_key).isNotNull())
            .groupBy(F.col(child_key).alias("_ck")).agg(F.count(F.lit(1)).alias("_n")))
    parent_keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    orphan_keys = (keys.join(parent_keys, F.col("_ck") == F.col("_pk"), "left_anti")
                   .select(F.col("_ck").alias("_ok")))
    return child.join(orphan_keys, F.col(child_key) == F.col("_ok"), "left_semi")


def integrity(events: DataFrame, customers: DataFrame, changes: DataFrame | None = None,
              customer_key: str = "id", records: DataFrame | None = None) -> DataFrame:
    """All key violations as rows (check, id, user_id): orphans of ``events`` and
    ``changes``, and repeated keys of customers, of ``records`` (id) and of the
    changelog (change_id where it is numbered, else the assertion's position and name)."""
    parts = [orphans(events, "user_id", customers, customer_key)
             .select(F.lit("orphan_event").alias("check"), F.col("id").cast("string").alias("id"),
                     "user_id")]
    if changes is not None:
        parts.append(orphans(changes, "user_id", customers, customer_key)
                     .select(F.lit("orphan_change").alias("check"),
                             F.col("position").cast("string").alias("id"), "user_id"))
    parts.append(duplicate_keys(customers, customer_key, "customer")
                 .select(F.lit("duplicate_customer").alias("check"), F.col("key").alias("id"),
                         F.lit(None).cast("bigint").alias("user_id")))
    repeated = [] if records is None else [("duplicate_record", records, F.col("id"))]
    if changes is not None:
        numbered = "change_id" in changes.columns
        key = F.col("change_id") if numbered else F.concat_ws(":", "position", "name")
        repeated.append(("duplicate_change", changes, key.cast("string")))
    for check, rows, key in repeated:
        parts.append(duplicate_keys(rows.select(key.alias("key_")), "key_", check)
                     .select(F.lit(check).alias("check"), F.col("key").alias("id"), F.lit(None).cast("bigint").alias("user_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_new_customers(requests: DataFrame, as_of: int,
                           attributes: str = "attributes") -> DataFrame:
    """P9-P11 on (id, attributes map) requests.

    email must be present and non-empty, else the request is rejected;
    created_at that is not epoch seconds is replaced by ``as_of`` (a
    parameter, so runs repeat). Adds ``status`` and ``reason``.
    """
    attrs = F.col(attributes)
    email = F.try_element_at(attrs, F.lit("email"))
    created = F.try_element_at(attrs, F.lit("created_at"))
    ok_email = email.isNotNull() & (email != "")
    fixed_created = F.when(is_epoch_seconds(created), created).otherwise(F.lit(str(as_of)))
    new_attrs = F.map_concat(F.map_filter(attrs, lambda k, v: k != "created_at"),
                             F.create_map(F.lit("created_at"), fixed_created))
    return requests.select(
        "*",
        F.when(ok_email, new_attrs).alias("accepted_attributes"),
        F.when(ok_email, F.lit("valid")).otherwise(F.lit("rejected")).alias("status"),
        F.when(ok_email, F.lit(None).cast("string"))
        .otherwise(F.lit("email attribute is required")).alias("reason"))


def erase(df: DataFrame, ids: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """D3: rows of ``df`` whose ``key`` is not in ``ids`` (left anti join).

    The result is meant to be written to a new path; Parquet tables are
    rewritten, not updated in place.
    """
    return df.join(ids.select(F.col(id_col).alias("_erase")).distinct(),
                   F.col(key) == F.col("_erase"), "left_anti")


def requests_to_records(validated: DataFrame, as_of: int, id_col: str = "id") -> DataFrame:
    """Accepted create/update requests as attributes records stamped
    ``as_of``, ready for ``merge_state`` (a customer missing from the state
    is inserted, a present one updated; the newest timestamp still wins
    per attribute). The request id is kept as ``position`` (tie-break)."""
    ok = validated.filter(F.col("status") == "valid")
    return ok.select(
        F.concat(F.lit("request-"), F.col(id_col).cast("string")).alias("id"),
        F.lit("attributes").alias("type"), F.lit(None).cast("string").alias("name"),
        F.col(id_col).cast("bigint").alias("user_id"),
        F.col("accepted_attributes").alias("data"),
        F.lit(as_of).cast("bigint").alias("timestamp"),
        F.col(id_col).cast("bigint").alias("position"))
