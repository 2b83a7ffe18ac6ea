"""ST1-ST6: finite streams (availableNow) equal their batch twins."""

import json
import os

from eventfold import attribute_changes, dedup_records, event_counts, latest_attributes
from eventfold.sources.records import read_records
from eventfold.streaming import (
    ndjson_stream,
    run_available_now,
    stream_attribute_changes,
    stream_event_counts,
    stream_latest_attributes,
)
from tests.helpers import rows_set


def _write_files(folder, files):
    # A file stream takes files in modification-time order; the batch
    # reader takes them in path order. Make both orders agree.
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(files):
        path = os.path.join(folder, f"part-{i}.ndjson")
        with open(path, "w") as f:
            for rec in lines:
                f.write(json.dumps(rec) + "\n")
        os.utime(path, (1_600_000_000 + i * 60, 1_600_000_000 + i * 60))


def _rec(i, typ, user, ts, **kw):
    r = {"id": f"r{i:04d}", "type": typ, "user_id": str(user), "timestamp": ts}
    r.update(kw)
    return r


def _files():
    f1 = [_rec(1, "attributes", 1, 100, data={"k": "a", "j": "x"}),
          _rec(2, "event", 1, 100, name="click"),
          _rec(3, "attributes", 2, 100, data={"k": "b"})]
    f2 = [_rec(4, "attributes", 1, 50, data={"k": "old"}),      # late, older: not the winner
          _rec(2, "event", 1, 100, name="click"),                # duplicate across batches
          _rec(5, "event", 2, 101, name="view"),
          {"id": "bad", "user_id": 7}]                           # quarantined
    f3 = [_rec(6, "attributes", 1, 200, data={"k": "c"}),
          _rec(7, "attributes", 2, 200, data={"k": "b"}),       # unchanged value
          _rec(8, "event", 1, 201, name="click")]
    return [f1, f2, f3]


def test_stream_equals_batch(spark, tmpdir_fresh):
    folder = f"{tmpdir_fresh}/in"
    _write_files(folder, _files())
    batch, _ = read_records(spark, folder)
    d = dedup_records(batch.drop("source"))

    valid, _ = ndjson_stream(spark, folder, max_files_per_trigger=1)
    counts, progress = run_available_now(stream_event_counts(valid), "complete", "t-counts")
    assert len([p for p in progress if p["numInputRows"] > 0]) == 3
    assert rows_set(counts) == rows_set(event_counts(d))

    valid, _ = ndjson_stream(spark, folder, max_files_per_trigger=1)
    latest, _ = run_available_now(stream_latest_attributes(valid), "complete", "t-latest")
    assert rows_set(latest, ["user_id", "key", "value", "timestamp"]) == \
        rows_set(latest_attributes(d), ["user_id", "key", "value", "timestamp"])

    valid, _ = ndjson_stream(spark, folder, max_files_per_trigger=1)
    changes, _ = run_available_now(stream_attribute_changes(valid), "append", "t-changes")
    cols = ["user_id", "name", "old_value", "value", "timestamp"]
    assert rows_set(changes, cols) == rows_set(attribute_changes(d), cols)


def test_watermark_dedup_and_progress_log(spark, tmpdir_fresh):
    from pyspark.sql import functions as F

    from eventfold.streaming import ProgressLog, stream_dedup
    folder = f"{tmpdir_fresh}/in"
    _write_files(folder, _files())
    seen = []
    listener = ProgressLog(every=3, sink=seen.append)
    spark.streams.addListener(listener)
    try:
        valid, _ = ndjson_stream(spark, folder, max_files_per_trigger=1)
        out, _ = run_available_now(stream_dedup(valid, watermark="1 hour").select("id"), "append", "t-wm")
        import time
        deadline = time.time() + 30   # listener events are delivered asynchronously
        while sum(b["rows"] for b in listener.batches) < 10 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    # r0002 is sent twice, in two batches within the watermark: kept once.
    assert sorted(r.id for r in out.collect()) == [f"r{i:04d}" for i in range(1, 9)]
    assert seen and seen[0] == "3 records read"
    assert sum(b["rows"] for b in listener.batches) == 10
    assert out.filter(F.col("id") == "r0002").count() == 1


def test_normalised_event_names(spark):
    from eventfold.sources.records import parse_lines
    df = spark.createDataFrame([('{"id":"x","type":"event","name":"Sign Up Now"}',)], "value string")
    valid, _ = parse_lines(df, normalise_names=True)
    assert valid.first().name == "signupnow"


def test_long_running_stream_stops_and_resumes(spark, tmpdir_fresh):
    from eventfold.streaming import read_sink, start_stream
    folder, out, ckpt = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ckpt"
    files = _files()
    _write_files(folder, files[:2])
    valid, _ = ndjson_stream(spark, folder)
    q = start_stream(stream_event_counts(valid), "complete", out, ckpt, "1 second")
    q.processAllAvailable()
    q.stop()
    first = rows_set(read_sink(spark, out))
    assert first == [(1, "click", 1), (2, "view", 1)]
    _write_files(f"{folder}-more", [files[2]])          # new input arrives
    os.replace(f"{folder}-more/part-0.ndjson", f"{folder}/part-2.ndjson")
    valid, _ = ndjson_stream(spark, folder)
    q = start_stream(stream_event_counts(valid), "complete", out, ckpt, "1 second")
    q.processAllAvailable()
    q.stop()
    assert rows_set(read_sink(spark, out)) == [(1, "click", 2), (2, "view", 1)]


def test_every_micro_batch_is_reported(spark, tmpdir_fresh):
    folder = f"{tmpdir_fresh}/in"
    _write_files(folder, [[_rec(i, "event", 1, i, name="n")] for i in range(12)])
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")  # what the query itself remembers
    try:
        valid, _ = ndjson_stream(spark, folder, max_files_per_trigger=1)
        out, progress = run_available_now(valid.select("id"), "append", "t-reports")
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert out.count() == 12
    assert [p["batchId"] for p in progress if p["numInputRows"]] == list(range(12))
    assert sum(p["numInputRows"] for p in progress) == 12


def test_changelog_takes_a_bucket_of_pairs_at_once():
    import random

    import pandas as pd

    from eventfold.streaming.stream import ChangeLogger

    class Value:
        held, calls = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.calls = value, self.calls + 1

    class Handle:
        value = Value()

        def getValueState(self, *_):
            return self.value

    r, handle, last = random.Random(1), Handle(), {}
    logger = ChangeLogger()
    logger.init(handle)
    columns = ["user_id", "key", "value", "timestamp", "position", "record_id"]
    for trigger in range(3):
        rows = [(r.randint(1, 40), r.choice(["k", "j", ""]), r.choice(["a", "b", "", "é\"\n"]), i, 1000 * trigger + i, f"r{i}") for i in range(400)]
        want = []
        for user, key, value, at, position, _ in rows:
            if last.get((user, key)) != value:
                want.append((user, key, last.get((user, key)), value, at, position))
            last[user, key] = value
        r.shuffle(rows)
        parts = [pd.DataFrame(x, columns=columns) for x in (rows[:150], rows[150:])]
        got = [tuple(x) for out in logger.handleInputRows((0,), iter(parts), None) for x in out.astype(object).itertuples(index=False)]
        assert sorted(got, key=lambda x: x[-1]) == want
    assert handle.value.calls == 3  # the state is written once a bucket and trigger, not once a pair
