"""J7, A12, P9-P11, D3 and the J6 incremental merge."""

from pyspark.sql import functions as F

from eventfold import attribute_changes, dedup_records, event_counts, latest_attributes
from eventfold.operators import checks
from eventfold.operators.merge import fold, load_state, merge_state, save_state
from tests.helpers import attr, event, recs, rows_set


def test_validate_new_customers(spark):
    req = spark.createDataFrame([
        (1, {"email": "a@x", "created_at": "1600000000"}),
        (2, {"email": "", "created_at": "1600000000"}),
        (3, {"created_at": "12"}),
        (4, {"email": "d@x", "created_at": "99999999"}),
        (5, {"email": "e@x", "created_at": " 1600000000"}),
        (6, {"email": "f@x"}),
    ], "id long, attributes map<string,string>")
    out = {r.id: r for r in checks.validate_new_customers(req, as_of=1234567890).collect()}
    assert [out[i].status for i in range(1, 7)] == ["valid", "rejected", "rejected", "valid", "valid", "valid"]
    assert out[1].accepted_attributes["created_at"] == "1600000000"
    assert out[4].accepted_attributes["created_at"] == "1234567890"
    assert out[5].accepted_attributes["created_at"] == "1234567890"   # blanks refused
    assert out[6].accepted_attributes == {"email": "f@x", "created_at": "1234567890"}
    assert out[2].reason == "email attribute is required" and out[2].accepted_attributes is None


def test_integrity_and_erase(spark):
    ev = recs(spark, [event("e1", 1, "click", 1, 1), event("e2", 9, "click", 1, 2),
                      event("e3", None, "view", 1, 3)])
    cust = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    got = rows_set(checks.integrity(ev, cust), ["check", "id", "user_id"])
    assert got == [("duplicate_customer", "2", None), ("orphan_event", "e2", 9)]
    kept = checks.erase(event_counts(ev), spark.createDataFrame([(1,)], "id long"), "user_id")
    assert rows_set(kept) == [(9, "click", 1)]


def test_merge_two_batches_equals_one(spark, tmpdir_fresh):
    rows = [
        attr("a1", 1, {"k": "x", "j": "1"}, 10, 1),
        event("e1", 1, "click", 10, 2),
        attr("a2", 1, {"k": "y"}, 5, 3),        # older: must not win
        event("e2", 2, "view", 11, 4),
        attr("a3", 2, {"k": "z"}, 12, 5),
        event("e1", 1, "click", 10, 6),         # resent in batch 2: counts once
        attr("a4", 1, {"j": "2"}, 20, 7),
        attr("a5", 2, {"k": "z"}, 30, 8),       # same value: no change
    ]
    whole = recs(spark, rows)
    b1, b2 = recs(spark, rows[:4]), recs(spark, rows[4:])
    path = f"{tmpdir_fresh}/state"
    save_state(fold(b1, path), path)
    s2, ch2 = merge_state(load_state(spark, path), b2, path)
    d = dedup_records(whole)
    assert rows_set(s2.latest) == rows_set(latest_attributes(d))
    assert rows_set(s2.counts) == rows_set(event_counts(d))
    ch_all = rows_set(attribute_changes(dedup_records(b1)).unionByName(ch2))
    assert ch_all == rows_set(attribute_changes(d))
    assert s2.records.count() == d.count()
    assert spark.read.parquet(f"{path}/records").count() == d.count()


def test_duplicate_keys_hot_key(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    got = rows_set(checks.duplicate_keys(df, "k", "t"))
    assert got == [("t", "7", 1667 + 1)]   # every third id, plus id 7 itself


def test_merge_with_bucketed_history_table(spark, tmpdir_fresh):
    rows = [attr("a1", 1, {"k": "x"}, 10, 1), event("e1", 1, "click", 10, 2),
            event("e1", 1, "click", 10, 3), attr("a2", 1, {"k": "y"}, 20, 4),
            event("e2", 1, "click", 11, 5)]
    b1, b2 = recs(spark, rows[:2]), recs(spark, rows[2:])
    path, table = f"{tmpdir_fresh}/state", "eventfold_test_records"
    save_state(fold(b1, path, table=table), path)
    s2, _ = merge_state(load_state(spark, path, table=table), b2, path, table=table)
    assert rows_set(s2.counts) == [(1, "click", 2)]
    assert rows_set(s2.latest, ["key", "value"]) == [("k", "y")]
    assert spark.table(table).count() == 4
    probe = spark.createDataFrame([("e1",), ("zz",)], "id string")
    old = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = probe.join(spark.table(table).select("id"), "id", "left_anti")
        assert [r.id for r in joined.collect()] == ["zz"]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        if old is not None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old)
        else:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan


def test_bucketed_store_writes_one_file_a_bucket(spark, tmpdir_fresh):
    import glob

    from eventfold.sources.sinks import store_records
    rows = [event(f"e{i}", i % 7, "click", 10, i) for i in range(400)]
    path, table = f"{tmpdir_fresh}/bucketed", "eventfold_test_bucketed"
    store_records(recs(spark, rows).repartition(9), path, load="l1", mode="overwrite", table=table, buckets=3)
    assert len(glob.glob(f"{path}/load=l1/*.parquet")) == 3
    assert spark.table(table).count() == 400
    spark.sql(f"DROP TABLE {table}")


def test_record_totals_against_plain_counting(spark):
    from eventfold.operators.paging import record_totals
    rows = [attr("a1", 1, {"k": "x"}, 10, 1), event("e1", 1, "click", 10, 2), event("e1", 1, "click", 10, 3), event("e2", 2, "click", 10, 4),
            event("e3", None, "view", 10, 5), event("e3", None, "view", 10, 6), attr("a2", None, {"k": "y"}, 20, 7), attr("a3", 3, {}, 20, 8),
            event("x", 9, "late copy", 10, 10), attr("x", 3, {"k": "z"}, 10, 9)]
    assert [tuple(r) for r in record_totals(recs(spark, rows)).collect()] == [(2, 1, 10, 7, 1)]
    assert [tuple(r) for r in record_totals(recs(spark, rows).limit(0)).collect()] == [(0, 0, 0, 0, 0)]
