"""Event-time repair against one batch; the upsert sink."""

import random

import pytest
from pyspark.sql import functions as F

from eventfold import attribute_changes, event_counts
from eventfold.operators.attributes import attribute_assertions
from eventfold.operators.intervals import applied, repair
from eventfold.schema import CHANGE
from eventfold.streaming.upserts import UpsertTable
from tests.helpers import attr, event, recs, rows_set

ROW = [f.name for f in CHANGE.fields]


@pytest.mark.parametrize(("seed", "span"), [(1, 3600), (2, 10), (3, 1)])
def test_repair_in_any_batch_order_equals_one_batch(spark, seed, span):
    r = random.Random(seed)
    rows = [attr(f"r{i}", r.randint(1, 2), {r.choice("kj"): r.choice("ab")}, r.randint(0, 60), i + 1) for i in range(70)]
    want = rows_set(attribute_changes(recs(spark, rows), order="event_time"), ROW)
    r.shuffle(rows)
    batches = [rows[:10], rows[10:11], rows[11:60], [], rows[60:]]
    log, done = spark.createDataFrame([], CHANGE), []
    for b in batches:
        ops = repair(attribute_assertions(recs(spark, done)), attribute_assertions(recs(spark, b)), span)
        log = spark.createDataFrame(applied(log, ops).collect(), CHANGE)
        done += b
        assert rows_set(log, ROW) == rows_set(attribute_changes(recs(spark, done), order="event_time"), ROW)
    assert rows_set(log, ROW) == want


def test_repair_names_the_neighbour_only(spark):
    old = [attr(f"o{i}", 1, {"k": v}, 100 * i, i + 1) for i, v in enumerate("abab")] + [attr("z", 2, {"k": "a"}, 5, 99)]
    ops = repair(attribute_assertions(recs(spark, old)), attribute_assertions(recs(spark, [attr("n", 1, {"k": "b"}, 50, 50)])), 30)
    assert rows_set(ops, ["op", "old_value", "value", "timestamp"]) == [("+", "a", "b", 50), ("-", "a", "b", 100)]


def test_upserts_replace_and_replay(spark, tmpdir_fresh):
    counts = event_counts(recs(spark, [event("e", 1, "n", 1, 1)]))
    t = UpsertTable(spark, f"{tmpdir_fresh}/t", counts.schema, ["user_id", "name"], create=True)
    assert t.read().count() == 0
    t.upsert(counts, 0)
    first = t.versions.current()
    t.upsert(counts.withColumn("n", F.lit(5).cast("bigint")).unionByName(counts.withColumn("user_id", F.lit(2).cast("bigint"))), 1)
    t.upsert(counts, 1)  # replayed
    assert rows_set(t.read()) == [(1, "n", 5), (2, "n", 1)] and rows_set(t.read(first)) == [(1, "n", 1)]
    t.compact()
    assert rows_set(t.read()) == [(1, "n", 5), (2, "n", 1)]
    t.upsert(counts.withColumn("n", F.lit(7).cast("bigint")), 2)
    assert rows_set(t.read()) == [(1, "n", 7), (2, "n", 1)]
