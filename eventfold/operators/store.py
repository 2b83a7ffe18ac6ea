"""The customers' stored state, merged batch by batch, erased and read at any time.

J6 upsert, J5 against history, D3 erase, D4 append of changes, P7 reads by
change id, ST4/ST5 upsert sinks. A ``Store`` is a versioned set of parts:

- ``records``   stored records, one per id (the J5 history)
- ``latest``    (user_id, key, value, timestamp, position), R3 winners
- ``counts``    (user_id, name, n)
- ``customers`` (user_id, last_updated)
- ``logged``    (user_id, key, value, position), last logged values
- ``changes``   the changelog, numbered without gaps in arrival order

All parts but ``records`` and ``changes`` hold partial aggregates: a merge
writes those of its batch only, and a read folds them by key (greatest time,
sum, greatest position). So what a merge writes grows with its batch, not with
the state, and the state is shuffled only where it is read whole. ``compact``
folds the small files into one set. Files are sorted by customer (records by
id), so a read of few customers skips row groups by their statistics.

Each merge publishes one version: readers see all parts before it or after it.
A merge names its batch; a batch that the current version has seen is skipped,
so a micro-batch that is replayed after a loss changes nothing.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.operators.attributes import attribute_assertions, last_updated, latest_attributes
from eventfold.operators.changes import attribute_changes, changes_for
from eventfold.operators.dedup import dedup_records
from eventfold.operators.events import event_counts
from eventfold.schema import CHANGE, COUNTS, RECORD, RECORD_COLUMNS
from eventfold.session import shared_dir
from eventfold.sources.versions import Version, Versions

_LONG, _TEXT = T.LongType(), T.StringType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS = {
    "records": RECORD,
    "latest": _schema(user_id=_LONG, key=_TEXT, value=_TEXT, timestamp=_LONG, position=_LONG),
    "counts": COUNTS,
    "customers": _schema(user_id=_LONG, last_updated=_LONG),
    "logged": _schema(user_id=_LONG, key=_TEXT, value=_TEXT, position=_LONG),
    "changes": T.StructType([T.StructField("change_id", _LONG), *CHANGE.fields]),
}
KEYS = {"latest": ("user_id", "key"), "counts": ("user_id", "name"), "customers": ("user_id",), "logged": ("user_id", "key")}
SORTED = {"records": ("id",), "changes": ("change_id",)} | KEYS


def folded(part: str, rows: DataFrame) -> DataFrame:
    """Partial aggregates of a part as one row a key."""
    if part not in KEYS:
        return rows
    if part == "counts":
        out = rows.groupBy("user_id", "name").agg(F.sum("n").alias("n"))
    elif part == "customers":
        out = rows.groupBy("user_id").agg(F.max("last_updated").alias("last_updated"))
    else:
        order = F.struct("timestamp", "position") if part == "latest" else F.col("position")
        others = [c for c in SCHEMAS[part].fieldNames() if c not in KEYS[part]]
        out = rows.groupBy("user_id", "key").agg(F.max_by(F.struct(*others), order).alias("_r")).select("user_id", "key", "_r.*")
    return out.select(*SCHEMAS[part].fieldNames())


def last_assertions(records: DataFrame) -> DataFrame:
    """(user_id, key, value, position) of the last assertion by arrival."""
    a = attribute_assertions(records).groupBy("user_id", "key").agg(F.max_by(F.struct("value", "position"), "position").alias("_r"))
    return a.select("user_id", "key", "_r.value", "_r.position")


def numbered(changes: DataFrame, after: int) -> DataFrame:
    """``change_id`` from ``after`` + 1 on without gaps, in arrival order.

    Changes are range-partitioned by their order and numbered within the
    partition; a partition starts where the ones before it end, from their row
    counts (one row a partition), so no window holds all changes.
    """
    order = ["position", "user_id", "name"]
    n = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = changes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = shared_dir(changes.sparkSession, "numbered")
    ranged.write.parquet(path)  # ranges come from a sample: numbers are fixed once written
    kept = changes.sparkSession.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")) \
        .select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.lit(after) + F.col("_start") + F.col("_at") - F.col("_first") + 1
    return kept.join(starts, "_part").withColumn("change_id", number.cast("bigint")).select(*SCHEMAS["changes"].fieldNames())


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root, SCHEMAS)

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        store = cls(spark, root)
        store.versions.create()
        return store

    def read(self, part: str, version: Version | None = None) -> DataFrame:
        """A part of the current version (or of ``version``), one row a key."""
        return folded(part, self.versions.read(part, version))

    def _write(self, part: str, df: DataFrame) -> tuple[str, ...]:
        return self.versions.write(part, df.sortWithinPartitions(*SORTED[part]))

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> Version:
        """Merge raw records (any order, with copies) and log their changes.

        Records that are stored already are dropped (J5). Positions must grow
        from batch to batch, as arrival does. Only the batch's own attributes
        are looked up in the state, after a semi join with their keys.
        """
        seen = self.versions.current()
        batch_id = seen.tag + 1 if batch_id is None else batch_id
        if batch_id <= seen.tag:
            return seen
        new = dedup_records(batch.select(*RECORD_COLUMNS), history=self.versions.read("records", seen))
        added = {"records": self._write("records", new)}
        stored = self.spark.read.schema(RECORD).parquet(*added["records"]) if added["records"] else self.spark.createDataFrame([], RECORD)
        logged = last_assertions(stored)
        prior = folded("logged", self.versions.read("logged", seen).join(logged.select("user_id", "key"), ["user_id", "key"], "left_semi"))
        changes = attribute_changes(stored, prior=prior)
        parts = {"latest": latest_attributes(stored), "counts": event_counts(stored), "customers": last_updated(stored), "logged": logged}
        added |= {p: self._write(p, df) for p, df in parts.items()}
        added["changes"] = self._write("changes", numbered(changes, self.last_change(seen)))
        return self.versions.next(seen, batch_id, added)

    def last_change(self, version: Version | None = None) -> int:
        return self.versions.read("changes", version).agg(F.max("change_id")).first()[0] or 0

    def compact(self) -> Version:
        """Fold the partial aggregates of all merges into one set of files."""
        seen = self.versions.current()
        added = {p: self._write(p, self.read(p, seen)) for p in KEYS}
        return self.versions.next(seen, seen.tag, added, {p: set(seen.files.get(p, ())) for p in KEYS})

    def erase(self, ids: DataFrame, id_col: str = "id") -> tuple[Version, dict[str, set[str]]]:
        """D3: remove customers from every part by copying the files that hold them.

        Files without them stay as they are. Returns the new version and the
        files that it no longer uses; their removal by ``vacuum`` ends the erasure.
        """
        seen = self.versions.current()
        gone = ids.select(F.col(id_col).cast("bigint").alias("user_id")).where("user_id is not null").distinct()
        added, removed = {}, {}
        for part in SCHEMAS:
            rows = self.versions.read(part, seen)
            if not seen.files.get(part):
                continue
            named = rows.select("user_id", F.col("_metadata.file_path").alias("file"))
            touched = {r["file"] for r in named.join(gone, "user_id", "left_semi").select("file").distinct().collect()}
            if not touched:
                continue
            same = {_same_path(unquote(t)) for t in touched}
            old = {f for f in seen.files[part] if _same_path(f) in same}
            kept = self.spark.read.schema(SCHEMAS[part]).parquet(*old).join(gone, "user_id", "left_anti")
            added[part], removed[part] = self._write(part, kept), old
        return self.versions.next(seen, seen.tag, added, removed), removed

    def vacuum(self, keep: int = 1, lost: bool = False) -> list[str]:
        """Remove the files that the last ``keep`` versions do not name, which ends
        an erasure for good (see ``Versions.vacuum``)."""
        return self.versions.vacuum(keep, lost)

    def changes(self, users: DataFrame | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        """The changelog, of the customers ``users`` or of an id range. The
        range reaches the scan, which skips row groups by their statistics."""
        out = self.versions.read("changes")
        if first is not None:
            out = out.where(F.col("change_id") >= first)
        if last is not None:
            out = out.where(F.col("change_id") <= last)
        return changes_for(out, users).select(*SCHEMAS["changes"].fieldNames())

    def profiles(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, attributes, events, last_updated), of some customers if given."""
        version = self.versions.current()
        take = (lambda df: df) if ids is None else (lambda df: df.join(ids.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi"))
        customers, latest, counts = (folded(p, take(self.versions.read(p, version))) for p in ("customers", "latest", "counts"))
        pairs = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
        attributes = latest.groupBy("user_id").agg(pairs(F.col("key"), F.col("value")).alias("attributes"))
        events = counts.groupBy("user_id").agg(pairs(F.coalesce("name", F.lit("")).alias("key"), F.col("n").alias("value")).alias("events"))
        empty = lambda kind: F.create_map().cast(kind)
        return customers.join(attributes, "user_id", "left").join(events, "user_id", "left").select(
            F.col("user_id").alias("id"), F.coalesce("attributes", empty("map<string,string>")).alias("attributes"),
            F.coalesce("events", empty("map<string,bigint>")).alias("events"), "last_updated")


def _same_path(file: str) -> str:
    """A file name as both ``inputFiles`` and ``_metadata`` write it."""
    return file.replace("file:///", "file:/")


def store_sink(store: Store):
    """``foreachBatch`` writer: each micro-batch is one merge, so that profiles,
    changes and counts can be read whole while the stream runs. A hot customer
    attribute goes through the batch changelog, which splits it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch, batch_id)
    return sink
