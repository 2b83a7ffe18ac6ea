"""J6 upsert of stored state with a new batch (D1 insert / D2 update), J5 against history.

State is a set of DataFrames; all but the first are keyed and small next
to the records:

- ``records``  stored deduplicated records (S7 fact table, J5 history)
- ``latest``   (user_id, key, value, timestamp, position), R3 winners
- ``counts``   (user_id, name, n)
- ``customers`` (user_id, last_updated)
- ``logged``   (user_id, key, value), last logged value per attribute

Merging unions old and new partial results and re-aggregates per key: a
customer missing from the state is inserted, a present one updated. As
R3 picks the greatest (timestamp, position) and counts add up, merging
batch 1 then batch 2 equals folding both at once, provided positions grow
across batches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.operators.attributes import last_updated, latest_attributes
from eventfold.operators.changes import attribute_changes, last_logged
from eventfold.operators.dedup import dedup_records
from eventfold.operators.events import event_counts
from eventfold.schema import RECORD_COLUMNS
from eventfold.sources.sinks import store_records

PARTS = ("latest", "counts", "customers", "logged")


@dataclass
class State:
    records: DataFrame   # stored deduplicated records (the J5 history)
    latest: DataFrame
    counts: DataFrame
    customers: DataFrame
    logged: DataFrame


def _parts(d: DataFrame) -> dict:
    return dict(latest=latest_attributes(d), counts=event_counts(d),
                customers=last_updated(d), logged=last_logged(d))


def fold(records: DataFrame, path: str | None = None, table: str | None = None) -> State:
    """State of one batch of raw records.

    With ``path`` (a shared folder) the deduplicated records are written
    there first (S7) and every part is derived from the written copy, so
    the dedup shuffle runs once and later plans start from Parquet. With
    ``table`` as well, they form a catalog table bucketed by id (see
    ``store_records``), which later merges join without shuffling it.
    """
    d = dedup_records(records)
    if path is not None:
        d = store_records(d, f"{path}/records", load=uuid.uuid4().hex, mode="overwrite",
                          table=table)
    return State(records=d, **_parts(d))


def merge_state(state: State, batch: DataFrame, path: str | None = None,
                table: str | None = None) -> tuple[State, DataFrame]:
    """(new state, changes logged by this batch).

    Records already stored (by id) are dropped first (J5), so a resent
    record neither counts twice nor logs a change. With ``path`` the new
    records are appended to the stored records there (to the bucketed
    ``table`` if given, whose history side of the J5 join is not shuffled).
    """
    new = dedup_records(batch, history=state.records)
    if path is not None:
        new = store_records(new, f"{path}/records", load=uuid.uuid4().hex, mode="append",
                            table=table)
    changes = attribute_changes(new, prior=state.logged)
    n = State(records=new, **_parts(new))
    order = F.struct("timestamp", "position")
    latest = (state.latest.unionByName(n.latest).groupBy("user_id", "key")
              .agg(F.max_by(F.struct("value", "timestamp", "position"), order).alias("_w"))
              .select("user_id", "key", "_w.value", "_w.timestamp", "_w.position"))
    counts = (state.counts.unionByName(n.counts).groupBy("user_id", "name")
              .agg(F.sum("n").alias("n")))
    customers = (state.customers.unionByName(n.customers).groupBy("user_id")
                 .agg(F.max("last_updated").alias("last_updated")))
    # A newer batch's last value replaces the stored one.
    logged = (state.logged.withColumn("_o", F.lit(0))
              .unionByName(n.logged.withColumn("_o", F.lit(1)))
              .groupBy("user_id", "key").agg(F.max_by("value", "_o").alias("value")))
    stored = state.records.unionByName(new)
    return State(records=stored, latest=latest, counts=counts, customers=customers,
                 logged=logged), changes


def save_state(state: State, path: str) -> None:
    """Write the aggregate parts as Parquet under ``path`` (a shared folder),
    which cuts the lineage of the next merge. Records are stored by
    ``fold`` / ``merge_state`` with a path (or ``store_records``)."""
    for part in PARTS:
        getattr(state, part).write.mode("overwrite").parquet(f"{path}/{part}")


def load_state(spark: SparkSession, path: str, table: str | None = None) -> State:
    """State written by ``save_state``; records from the bucketed ``table``
    when given (keeps its bucketing), else from ``path``."""
    parts = {part: spark.read.parquet(f"{path}/{part}") for part in PARTS}
    src = spark.table(table) if table else spark.read.parquet(f"{path}/records")
    return State(records=src.select(*RECORD_COLUMNS), **parts)
