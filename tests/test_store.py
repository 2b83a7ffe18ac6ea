"""The stored state: merges, erasure, change ids, compaction, versions, stream sink."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from eventfold import attribute_changes, dedup_records, event_counts, last_updated, latest_attributes
from eventfold.operators.store import SCHEMAS, Store, store_sink
from eventfold.sources import ndjson
from eventfold.sources.records import parse_lines
from tests.helpers import attr, event, recs, rows_set


def some(users=12, n=240):
    out = []
    for i in range(n):
        u = i * 7 % users
        out.append(attr(f"a{i}", u, {"k": f"v{i * 5 % 3}", f"x{i % 4}": str(i % 2)}, 1000 - i * 37 % 90, 10 * i + 1))
        out.append(event(f"e{i}", u if i % 9 else None, f"n{i % 3}", i, 10 * i + 2))
        if i % 5 == 0:
            out.append(event(f"e{i // 2}", (i // 2) * 7 % users if (i // 2) % 9 else None, f"n{(i // 2) % 3}", i // 2, 10 * i + 3))
    return out


def fresh(spark, folder, batches):
    store = Store.create(spark, f"{folder}/store")
    for b in batches:
        store.merge(recs(spark, b))
    return store


def check(spark, store, rows):
    d = dedup_records(recs(spark, rows))
    assert rows_set(store.read("latest")) == rows_set(latest_attributes(d))
    assert rows_set(store.read("counts")) == rows_set(event_counts(d))
    assert rows_set(store.read("customers")) == rows_set(last_updated(d))
    cols = ["user_id", "name", "old_value", "value", "timestamp", "position"]
    got = store.changes().orderBy("change_id").collect()
    assert [r.change_id for r in got] == list(range(1, len(got) + 1))
    assert [(r.position, r.user_id, r.name) for r in got] == sorted((r.position, r.user_id, r.name) for r in got)
    assert rows_set(store.changes(), cols) == rows_set(attribute_changes(d), cols)


def test_merges_equal_one_batch_in_a_new_session_setting(spark, tmpdir_fresh):
    rows = some()
    store = fresh(spark, tmpdir_fresh, [rows[:200], rows[200:230], []])
    check(spark, store, rows[:230])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = Store(spark, f"{tmpdir_fresh}/store")
        again.merge(recs(spark, rows[230:] + rows[:40]))
        check(spark, again, rows)
        again.compact()
        check(spark, again, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def size(spark, store, part, files):
    return spark.read.schema(SCHEMAS[part]).parquet(*files).count() if files else 0


def test_a_small_merge_writes_little(spark, tmpdir_fresh):
    rows = some(users=60, n=1200)
    cut = len(rows) - len(rows) // 100
    store = fresh(spark, tmpdir_fresh, [rows[:cut]])
    old = store.versions.current()
    store.merge(recs(spark, rows[cut:]))
    new = store.versions.current()
    for part in SCHEMAS:
        assert set(old.files.get(part, ())) <= set(new.files.get(part, ()))
        added = set(new.files.get(part, ())) - set(old.files.get(part, ()))
        assert size(spark, store, part, added) <= 4 * (len(rows) - cut)
    check(spark, store, rows)


def test_a_replayed_batch_changes_nothing(spark, tmpdir_fresh):
    rows = some()
    store = fresh(spark, tmpdir_fresh, [])
    store.merge(recs(spark, rows[:100]), 0)
    store.merge(recs(spark, rows[100:]), 1)
    again = store.merge(recs(spark, rows[100:]), 1)
    assert again.number == 2 and again.tag == 1
    check(spark, store, rows)


def test_erase_copies_touched_files_only(spark, tmpdir_fresh):
    rows = some(users=12)
    mine = [r for r in rows if r[3] in (3, 4)]
    others = [r for r in rows if r[3] not in (3, 4)]
    store = fresh(spark, tmpdir_fresh, [others, [(i + "x", *rest[:-1], rest[-1] + 10**6) for i, *rest in mine]])
    old = store.versions.current()
    kept = {p: rows_set(store.versions.read(p).where("user_id is null or user_id not in (3, 4)")) for p in SCHEMAS}
    new, removed = store.erase(spark.createDataFrame([(3,), (4,), (None,)], "id bigint"))
    for part in SCHEMAS:
        assert rows_set(store.versions.read(part)) == kept[part]
        assert store.versions.read(part).where("user_id in (3, 4)").count() == 0
        untouched = set(old.files[part]) - removed[part]
        assert untouched and untouched <= set(new.files[part])
        assert spark.read.schema(SCHEMAS[part]).parquet(*removed[part]).where("user_id in (3, 4)").count() > 0
    assert store.read("counts", old).where("user_id = 3").count() > 0  # a reader of the version before still sees it whole
    assert store.erase(spark.createDataFrame([(99,)], "id bigint"))[1] == {}


def test_changes_by_id_and_by_customer(spark, tmpdir_fresh):
    store = fresh(spark, tmpdir_fresh, [some()])
    every = rows_set(store.changes())
    assert rows_set(store.changes(first=5, last=9)) == [r for r in every if 5 <= r[0] <= 9]
    users = spark.createDataFrame([(3,), (3,), (77,)], "user_id bigint")
    assert rows_set(store.changes(users)) == [r for r in every if r[1] == 3]
    plan = store.changes(first=5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(change_id,5)" in plan  # the range reaches the scan


def test_two_writers_cannot_publish_the_same_version(spark, tmpdir_fresh):
    store = fresh(spark, tmpdir_fresh, [some()[:20]])
    seen = store.versions.current()
    store.versions.next(seen, 5, {})
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.versions.next(seen, 6, {})
    assert store.versions.current().tag == 5


def test_a_reader_sees_whole_versions_while_a_stream_merges(spark, tmpdir_fresh):
    """All parts of a version agree on how many records were merged."""
    folder = f"{tmpdir_fresh}/in"
    os.makedirs(folder)
    store = fresh(spark, tmpdir_fresh, [])
    stream = parse_lines(ndjson.stream_lines(spark, folder))[0]
    seen, stop = set(), threading.Event()

    def reader():
        while not stop.is_set():
            v = store.versions.current()
            records = store.read("records", v).count()
            counted = store.read("counts", v).agg(F.sum("n")).first()[0] or 0
            seen.add((v.number, records, counted))

    watch = threading.Thread(target=reader)
    watch.start()
    for f in range(3):
        with open(f"{folder}/p{f}", "w") as out:
            out.writelines(json.dumps({"id": f"{f}-{i}", "type": "event", "name": "n", "user_id": "1"}) + "\n" for i in range(10))
        q = stream.writeStream.option("checkpointLocation", f"{tmpdir_fresh}/ckpt").foreachBatch(store_sink(store)).trigger(availableNow=True).start()
        q.awaitTermination()
    stop.set()
    watch.join()
    seen.add((3, store.read("records").count(), store.read("counts").first()["n"]))
    assert all(records == counted == 10 * number for number, records, counted in seen)
    assert (3, 30, 30) in seen and len(seen) > 1


def test_one_hot_attribute_in_one_trigger(spark, tmpdir_fresh):
    """A million assertions of one key in a batch stay split: each window partition is one span of input."""
    n = 300_000
    store = fresh(spark, tmpdir_fresh, [])
    rows = spark.range(n).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.lit("attributes").alias("type"), F.lit(None).cast("string").alias("name"),
        F.lit(1).cast("bigint").alias("user_id"), F.create_map(F.lit("k"), (F.col("id") % 2).cast("string")).alias("data"),
        F.lit(1).cast("bigint").alias("timestamp"), (F.col("id") * 1000).alias("position"))
    store.merge(rows)
    assert store.last_change() == n
    assert store.changes(first=n).first()["value"] == str((n - 1) % 2)


def test_vacuum_ends_an_erasure(spark, tmpdir_fresh):
    rows = some()
    store = fresh(spark, f"{tmpdir_fresh}/a folder", [rows[:150], rows[150:]])
    store.versions.write("counts", spark.createDataFrame([(3, "lost", 1)], SCHEMAS["counts"]))  # of a writer that failed
    _, removed = store.erase(spark.createDataFrame([(3,)], "id bigint"))
    want = {p: rows_set(store.versions.read(p)) for p in SCHEMAS}
    gone = store.vacuum(keep=2)
    assert not set(gone) & {f.removeprefix("file://") for files in removed.values() for f in files}  # the version before still reads
    gone += store.vacuum()
    assert len(gone) == sum(map(len, removed.values())) and not any(os.path.exists(f) for f in gone)
    assert {p: rows_set(Store(spark, f"{tmpdir_fresh}/a folder/store").versions.read(p)) for p in SCHEMAS} == want
    lost = store.vacuum(lost=True)
    assert len(lost) >= 1 and store.vacuum(lost=True) == []
    stored = spark.read.option("recursiveFileLookup", "true").schema("user_id bigint").parquet(f"{tmpdir_fresh}/a folder/store/data")
    assert stored.where("user_id = 3").count() == 0
    store.merge(recs(spark, [event("late", 5, "n9", 1, 10**7)]))
    assert store.read("counts").where("name = 'n9'").count() == 1
