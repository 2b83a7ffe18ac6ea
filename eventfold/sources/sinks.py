"""S7 event fact sink and S8 profile JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.schema import RECORD_COLUMNS


def event_date() -> F.Column:
    return F.to_date(F.timestamp_seconds(F.coalesce("timestamp", F.lit(0))))


def _buckets_of(spark: SparkSession, table: str) -> int | None:
    """Bucket count of an existing table: the session's setting may have changed since."""
    if not spark.catalog.tableExists(table):
        return None
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return int(rows["Num Buckets"]) if "Num Buckets" in rows else None


def store_records(records: DataFrame, path: str, load: str, mode: str = "append",
                  by_date: bool = False, table: str | None = None,
                  buckets: int | None = None) -> DataFrame:
    """Write deduplicated records under ``path`` partitioned by ``load``
    (and ``event_date`` when ``by_date``), and return the written slice,
    read back (which cuts the lineage).

    ``load`` names the batch; reading one load prunes to its folders.
    ``by_date`` suits loads spanning many days of large data, where date
    pruning pays for the extra files; small loads are better without it.

    With ``table`` the records go to an external catalog table at
    ``path``, bucketed and sorted by ``id`` into ``buckets`` buckets. A
    later anti join on ``id`` against that table (J5) then scans the
    stored history without shuffling it; only the new batch is shuffled.
    """
    spark = records.sparkSession
    parts = ["load", "event_date"] if by_date else ["load"]
    out = (records.select(*RECORD_COLUMNS)
           .withColumn("load", F.lit(load)).withColumn("event_date", event_date()))
    if by_date and table is None:
        # a day's rows go to few tasks, so files number about the days, not days times tasks;
        # a day with many rows is split by id
        out = out.repartitionByRange("event_date", "id")
    if table is None:
        out.write.mode(mode).partitionBy(*parts).parquet(path)
        stored = spark.read.parquet(path)
    else:
        n = buckets or _buckets_of(spark, table) or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # rows meet by bucket before the write, so a bucket is one file (a day) whatever the session's settings
        (out.repartition(n, "id").write.mode(mode).format("parquet").option("path", path).partitionBy(*parts)
         .bucketBy(n, "id").sortBy("id").saveAsTable(table))
        stored = spark.table(table)
    return stored.filter(F.col("load") == load).select(*RECORD_COLUMNS)


def write_profiles_json(profile: DataFrame, path: str) -> None:
    """One JSON object per customer (id, attributes, events, last_updated)."""
    (profile.select("id", "attributes", "events",
                    F.coalesce("last_updated", F.lit(0)).alias("last_updated"))
     .write.mode("overwrite").json(path))
