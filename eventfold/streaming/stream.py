"""Streaming ingest.

ST1 record stream: ``readStream`` over NDJSON text or the events parquet,
    run with ``trigger(availableNow=True)`` (ends at the end of input) or
    stopped with ``query.stop()``; ``maxFilesPerTrigger`` is the back-pressure.
ST2 dedup: ``dropDuplicates(["id"])`` keeps every id forever (the
    reference's keep-forever table); ``dropDuplicatesWithinWatermark``
    bounds the state by event time instead.
ST3 changelog: ``transformWithStateInPandas`` keyed by a bucket of (user_id,
    key) pairs, a ValueState holding the last logged value of each pair.
ST4 running counts and ST5 running latest attributes: streaming
    aggregations (a late, older value never overwrites: R3 holds).
ST6 progress: listeners that see every micro-batch (``Reports``, ``ProgressLog``).

Streams carry no byte position for NDJSON input; there ``id`` breaks ties.
"""

from __future__ import annotations

import json
import sys
import threading
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventfold.operators.attributes import attribute_assertions
from eventfold.operators.events import event_counts
from eventfold.schema import CHANGE
from eventfold.session import shared_dir
from eventfold.sources.ndjson import file_system
from eventfold.sources.records import parse_lines
from eventfold.sources.tables import records_from_events

# Functions of this module run inside Python workers (Arrow / state API);
# pickle them by value so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """ST1 over the driver's events parquet, as records."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    ev = (spark.readStream.schema(schema)
          .option("pathGlobFilter", "events.parquet")
          .option("maxFilesPerTrigger", max_files_per_trigger)
          .parquet(sf_dir))
    return records_from_events(ev)


def records_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = 1) -> DataFrame:
    """ST1 over stored records, file by file in the order they were written, or
    with no limit all that is there in one trigger."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def ndjson_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100
                  ) -> tuple[DataFrame, DataFrame]:
    """ST1 over NDJSON files: (valid records, quarantine); position is NULL."""
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
             .option("lineSep", "\n").text(path)
             .select(F.regexp_replace("value", "\r$", "").alias("value")))
    return parse_lines(lines)


def stream_dedup(records: DataFrame, watermark: str | None = None) -> DataFrame:
    """ST2: first arrival of each id. With ``watermark`` (e.g. "1 hour") the
    state is bounded by time of arrival; copies that arrive further apart than
    that are no longer recognised (exactness traded for bounded state). The
    watermark is on arrival, not on the record's own time: a record that is
    late, or has no timestamp, is never dropped as too old."""
    if watermark is None:
        return records.dropDuplicates(["id"])
    return (records.withColumn("arrived", F.current_timestamp())
            .withWatermark("arrived", watermark)
            .dropDuplicatesWithinWatermark(["id"])
            .drop("arrived"))


def stream_event_counts(records: DataFrame) -> DataFrame:
    """ST4: running (user_id, name, n) after ST2."""
    return event_counts(stream_dedup(records))


def stream_latest_attributes(records: DataFrame) -> DataFrame:
    """ST5: running R3 winners per (user_id, key); ``id`` breaks ties when
    there is no position."""
    a = attribute_assertions(stream_dedup(records), with_id=True)
    order = F.struct("timestamp", F.coalesce("position", F.lit(0)).alias("p"), "record_id")
    return (a.groupBy("user_id", "key")
            .agg(F.max_by(F.struct("value", "timestamp", "position"), order).alias("_w"))
            .select("user_id", "key", "_w.value", "_w.timestamp", "_w.position"))


#: Buckets of (user_id, key) pairs of the changelog's state: fixed, as a stream
#: goes on from its checkpoint. A trigger calls Python once a bucket that it
#: touches, and rewrites that bucket's state, not once a pair.
BUCKETS = 4096


class ChangeLogger(StatefulProcessor):
    """ST3: per (user_id, key), log an assertion whose value differs from the
    last logged one. Rows of one micro-batch are taken in arrival order
    (position, then id). A bucket's pairs are taken together; its state is the
    JSON list of their (user_id, key, last value). A key's rows of one micro-batch
    are in one task, so the trigger's size bounds them;
    ``operators.store.store_sink`` splits a hot key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "pairs string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        if not len(pdf):
            return
        pdf = pdf.sort_values(["user_id", "key", "position", "record_id"], na_position="first", kind="stable")
        users = pdf["user_id"].to_numpy()
        names, values = (pdf[c].astype(object).to_numpy() for c in ("key", "value"))
        last = {(u, k): v for u, k, v in json.loads(self.last.get()[0])} if self.last.exists() else {}
        starts = np.concatenate(([True], (users[1:] != users[:-1]) | (names[1:] != names[:-1])))
        # The previous assertion's value is the last logged one (an
        # unchanged value logs nothing); a pair's first row compares with state.
        prev = np.concatenate(([None], values[:-1]))
        for i in np.flatnonzero(starts).tolist():
            prev[i] = last.get((int(users[i]), names[i]))
        changed = values != prev
        for i in np.flatnonzero(np.append(starts[1:], True)).tolist():
            last[int(users[i]), names[i]] = values[i]
        self.last.update((json.dumps([[u, k, v] for (u, k), v in last.items()], ensure_ascii=False, separators=(",", ":")),))
        out = pd.DataFrame({
            "user_id": users[changed], "name": names[changed], "old_value": prev[changed], "value": values[changed],
            "timestamp": pdf["timestamp"].to_numpy()[changed], "position": pdf["position"].to_numpy()[changed],
        })
        if len(out):
            yield out[[f.name for f in CHANGE.fields]]

    def close(self) -> None:
        pass


def stream_attribute_changes(records: DataFrame) -> DataFrame:
    """ST3 as a stream of change rows (append)."""
    spark = records.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    a = attribute_assertions(stream_dedup(records), with_id=True)
    bucket = F.pmod(F.xxhash64("user_id", "key"), F.lit(BUCKETS)).cast("int")
    return (a.withColumn("bucket", bucket).groupBy("bucket")
            .transformWithStateInPandas(ChangeLogger(), CHANGE, "append", "None"))


#: Results of a ``complete`` stream that stay for readers that hold them.
KEPT = 4
POINTER = "batch bigint, folder string"


def _parquet_sink(out: str, mode: str):
    """foreachBatch writer. ``complete`` writes each batch's result to a folder of
    its own and then names that folder in one row of ``current``, so a reader sees
    the result before or after a trigger, never a part; older folders than the
    last ``KEPT`` are removed. ``append`` writes one sub-folder per batch id. A
    replayed batch gives the same result in both modes."""
    written: deque[str] = deque()

    def sink(batch: DataFrame, batch_id: int) -> None:
        if mode != "complete":
            batch.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")
            return
        folder = f"{out}/whole/{uuid.uuid4().hex}"
        batch.write.parquet(folder)
        batch.sparkSession.createDataFrame([(batch_id, folder)], POINTER).coalesce(1).write.mode("append").parquet(f"{out}/current")
        written.append(folder)
        while len(written) > KEPT:
            system, inner = file_system(written.popleft())
            system.delete_dir(inner)
    return sink


def start_stream(df: DataFrame, mode: str, out: str, checkpoint: str,
                 processing_time: str = "10 seconds"):
    """ST1 long-running form: start the query on a processing-time trigger
    and return its handle; ``query.stop()`` ends it early, and a restart
    with the same checkpoint resumes where it stopped."""
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(_parquet_sink(out, mode)).trigger(processingTime=processing_time).start())


def read_sink(spark: SparkSession, out: str, mode: str = "complete") -> DataFrame:
    """What a stream in ``mode`` has written to ``out`` so far."""
    if mode != "complete":
        return spark.read.parquet(f"{out}/table").drop("batch")
    newest = spark.read.schema(POINTER).parquet(f"{out}/current").agg(F.max_by("folder", "batch")).first()[0]
    return spark.read.parquet(newest)


def run_available_now(df: DataFrame, mode: str, name: str, folders: tuple[str, str] | None = None) -> tuple[DataFrame, list]:
    """Run a streaming DataFrame over all available input and return its
    result as a static DataFrame plus the progress reports (ST6), one of every
    micro-batch.

    The sink is ``foreachBatch`` writing Parquet under the shared folder
    (see ``_parquet_sink``). ``folders`` (output, checkpoint) of an earlier run
    make this one go on where that ended.
    """
    spark = df.sparkSession
    out, ckpt = folders or stream_folders(spark, name)
    reports = Reports()
    spark.streams.addListener(reports)
    try:
        q = (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
             .foreachBatch(_parquet_sink(out, mode)).trigger(availableNow=True).start())
        q.awaitTermination()
        progress = reports.of(str(q.runId))
    finally:
        spark.streams.removeListener(reports)
    return read_sink(spark, out, mode), progress


def stream_folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """New output and checkpoint folders for ``run_available_now``."""
    return shared_dir(spark, f"stream-{name}"), shared_dir(spark, f"stream-{name}-checkpoint")


class Reports(StreamingQueryListener):
    """ST6: the progress reports of every micro-batch by run; a query itself
    remembers its last hundred only. Each report is cut to its number, times,
    rows and offsets, a few hundred bytes a micro-batch on the driver."""

    KEEP = ("batchId", "timestamp", "numInputRows", "batchDuration")

    def __init__(self):
        self.runs: dict[str, list[dict]] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        report = {k: getattr(p, k) for k in self.KEEP}
        report["sources"] = [{"startOffset": s.startOffset, "endOffset": s.endOffset, "numInputRows": s.numInputRows} for s in p.sources]
        self.runs.setdefault(str(p.runId), []).append(report)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, run: str, timeout: float = 60) -> list[dict]:
        """All reports of a run that has ended. Events arrive in order but later
        than the query's end, so this waits for the run's last one."""
        if not self._end(run).wait(timeout):
            raise TimeoutError(f"no end of run {run} was reported in {timeout} s")
        return self.runs.get(run, [])


class ProgressLog(StreamingQueryListener):
    """ST6: report input progress every ``every`` rows (driver-side; it
    sees one progress event per micro-batch, never the rows)."""

    def __init__(self, every: int = 1000, sink=print):
        self.every, self.sink = every, sink
        self.rows, self._next = 0, every
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.batches.append({"batch": p.batchId, "rows": p.numInputRows})
        while self.rows >= self._next:
            self.sink(f"{self._next} records read")
            self._next += self.every

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
