"""ST4, ST5: streaming aggregates in update mode into a table readable at any time.

A trigger's updated rows are written as new files and published as one version
(``sources.versions``); a read takes each key's newest row. So a trigger writes
what it changed, never the whole result, and never the files being read.
``compact`` keeps the newest rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.sources.ndjson import exists
from eventfold.sources.versions import Version, Versions
from eventfold.streaming.stream import stream_folders

PART = "rows"


class UpsertTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], create: bool = False):
        self.schema, self.keys = schema, keys
        self.versions = Versions(spark, root, {PART: T.StructType([*schema.fields, T.StructField("_trigger", T.LongType())])})
        if create:
            self.versions.create()

    def upsert(self, rows: DataFrame, trigger: int) -> Version:
        """The trigger's rows replace those of the same keys. A trigger that is
        replayed is known by its number and changes nothing."""
        seen = self.versions.current()
        if trigger <= seen.tag:
            return seen
        added = self.versions.write(PART, rows.withColumn("_trigger", F.lit(trigger).cast("bigint")).sortWithinPartitions(*self.keys))
        return self.versions.next(seen, trigger, {PART: added})

    def read(self, version: Version | None = None) -> DataFrame:
        others = [c for c in self.schema.fieldNames() if c not in self.keys]
        rows = self.versions.read(PART, version)
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_trigger").alias("_r")).select(*self.keys, "_r.*") \
            .select(*self.schema.fieldNames())

    def compact(self) -> Version:
        seen = self.versions.current()
        added = self.versions.write(PART, self.read(seen).withColumn("_trigger", F.lit(seen.tag).cast("bigint")).sortWithinPartitions(*self.keys))
        return self.versions.next(seen, seen.tag, {PART: added}, {PART: set(seen.files.get(PART, ()))})


def run_upserts(df: DataFrame, keys: list[str], name: str, folders: tuple[str, str] | None = None) -> UpsertTable:
    """Run a streaming aggregation over all available input into a table: a new
    one, or that of an earlier run's ``folders`` (table, checkpoint)."""
    root, checkpoint = folders or stream_folders(df.sparkSession, f"upserts-{name}")
    table = UpsertTable(df.sparkSession, root, df.schema, keys, create=not exists(root))
    query = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(table.upsert).trigger(availableNow=True).start()
    query.awaitTermination()
    return table
