"""Driver parquet tables and the adapter from ``events`` rows to records.

The ``events`` table has neither attribute records, duplicates, anonymous rows
nor late values. The adapter writes each row the way the record stream
interleaves them, in six position slots a row (one file in ``event_id`` order):

0. ``a-<id>``: attributes of the row's user: key = event type, value =
   ``props.k``; every 3rd row also has a text under ``zone``, a key that is no
   event name. Every 70th has no timestamp.
1. ``e-<id>``: the event. Every 500th has no user, every 60th a user that no
   attributes record and no customer row names (an orphan with events only).
2. A byte-identical copy of the event for every 20th row: half of them at
   once, half 1,000 rows later, behind a batch's end.
3. ``d-<id>``, every 10th row: an older value of the same attribute, text, that
   arrives later, so the newest value is not the last one.
4. ``n-<id>``, every 100th row: a NULL ``zone``; by turns a newer one of the
   row's user, which must not erase the value, and the only record, without a
   timestamp, of a customer that the customer table lacks.

No row is dropped: every events row yields records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions.expr import epoch_seconds

# Duplicate and anonymous rates of the record stream.
DUPLICATE_EVERY = 20
ANONYMOUS_EVERY = 500
SLOTS = 6
FAR_ROWS = 1000
LATE_SECONDS = 10_000_000
ORPHAN_USERS = 10_000_000
NULL_USERS = 30_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _record(id_: Column, type_: str, name: Column, user_id: Column, data: Column,
            ts: Column, position: Column) -> Column:
    return F.struct(
        id_.alias("id"), F.lit(type_).alias("type"), name.cast("string").alias("name"),
        user_id.cast("bigint").alias("user_id"), data.alias("data"),
        ts.alias("timestamp"), position.cast("bigint").alias("position"))


def records_from_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, props) -> records.

    One scan, one Generate: each row expands to its two or three records
    in place, so the adapter adds no shuffle.
    """
    ts_type = events.schema["ts"].dataType
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    tsec = epoch_seconds("ts", ts_type)
    base = events.select(eid.alias("eid"), F.col("user_id").alias("uid"),
                         F.col("event_type").alias("etype"), k.alias("k"), tsec.alias("tsec"))
    eid, uid, etype, k, tsec = (F.col(c) for c in ("eid", "uid", "etype", "k", "tsec"))
    sid = eid.cast("string")
    slot = eid * SLOTS
    no_text = F.lit(None).cast("string")
    zone = F.concat(F.lit("zone-"), (eid % 11).cast("string"))
    pairs = F.when(eid % 3 == 0, F.create_map(etype, k, F.lit("zone"), zone)).otherwise(F.create_map(etype, k))
    attrs = _record(F.concat(F.lit("a-"), sid), "attributes", F.lit(None), uid,
                    F.when(etype.isNotNull(), pairs)
                    .otherwise(F.create_map().cast("map<string,string>")),
                    F.when(eid % 70 != 3, tsec), slot)
    ev_user = (F.when(eid % ANONYMOUS_EVERY == ANONYMOUS_EVERY - 1, F.lit(None))
               .when(eid % 60 == 11, uid + ORPHAN_USERS).otherwise(uid))

    def event(position: Column) -> Column:
        return _record(F.concat(F.lit("e-"), sid), "event", etype, ev_user,
                       F.create_map(F.lit("k"), k), tsec, position)

    far = F.when(eid % (2 * DUPLICATE_EVERY) == 0, slot).otherwise(slot + FAR_ROWS * SLOTS)
    copy = F.when(eid % DUPLICATE_EVERY == 0, event(far + 2))
    late = F.when((eid % 10 == 3) & etype.isNotNull(), _record(
        F.concat(F.lit("d-"), sid), "attributes", F.lit(None), uid,
        F.create_map(etype, F.concat(F.lit("old-"), k)), tsec - LATE_SECONDS, slot + 3))
    own = eid % 200 == 7
    null = F.when(eid % 100 == 7, _record(
        F.concat(F.lit("n-"), sid), "attributes", F.lit(None), F.when(own, uid).otherwise(uid + NULL_USERS),
        F.create_map(F.lit("zone"), no_text), F.when(own, tsec + 1), slot + 4))
    # A NULL slot (no copy) inlines to an all-NULL row, removed by the
    # filter; no lambda, so the stage stays in generated code.
    return (base.select(F.inline(F.array(attrs, event(slot + 1), copy, late, null)))
            .filter(F.col("id").isNotNull()))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_from_events(table(spark, sf_dir, "events"))
