"""R1-R5 and the small semantic cases of FIXTURES section 6."""

from pyspark.sql import functions as F

from eventfold import (
    attribute_changes,
    dedup_records,
    event_counts,
    latest_attributes,
    profiles,
)
from eventfold.operators import paging
from eventfold.operators.attributes import row_last_arrival
from tests.helpers import attr, event, recs, rows_set


def test_newest_attribute_wins_even_if_it_arrives_first(spark):
    df = recs(spark, [
        attr("a1", 1, {"email": "new@x"}, 200, 10),
        attr("a2", 1, {"email": "old@x", "city": "paris"}, 100, 20),
    ])
    got = {r.key: r.value for r in latest_attributes(dedup_records(df)).collect()}
    assert got == {"email": "new@x", "city": "paris"}


def test_ties_on_timestamp_broken_by_position(spark):
    df = recs(spark, [attr("a1", 1, {"k": "first"}, 5, 1), attr("a2", 1, {"k": "second"}, 5, 2)])
    assert latest_attributes(df).first().value == "second"


def test_same_event_twice_counts_once(spark):
    df = recs(spark, [event("e1", 1, "click", 1, 1), event("e1", 1, "click", 1, 2),
                      event("e2", 1, "click", 2, 3)])
    d = dedup_records(df)
    assert d.count() == 2
    assert rows_set(event_counts(d)) == [(1, "click", 2)]
    assert {r.position for r in d.collect()} == {1, 3}   # first copy kept


def test_anonymous_event_in_no_profile(spark):
    df = recs(spark, [attr("a", 1, {"k": "v"}, 1, 1), event("e", None, "click", 1, 2)])
    p = profiles(dedup_records(df)).collect()
    assert len(p) == 1 and p[0].events == {}


def test_events_alone_create_no_customer(spark):
    df = recs(spark, [event("e", 7, "click", 1, 1), attr("a", 1, {"k": "v"}, 1, 2)])
    assert [r.id for r in profiles(df).collect()] == [1]
    cust = spark.createDataFrame([(7,), (1,)], "c_custkey long")
    p = {r.id: r for r in profiles(df, cust).collect()}
    assert p[7].events == {"click": 1} and p[7].attributes == {}


def test_empty_string_is_a_value_null_is_not(spark):
    df = recs(spark, [attr("a1", 1, {"k": "v"}, 1, 1), attr("a2", 1, {"k": ""}, 2, 2),
                      attr("a3", 1, {"k": None}, 3, 3)])
    assert latest_attributes(df).first().value == ""


def test_changelog_keeps_commas_and_skips_repeats(spark):
    df = recs(spark, [
        attr("a1", 1, {"city": "Paris, France"}, 1, 1),
        attr("a2", 1, {"city": "Paris, France"}, 2, 2),   # same value again: no change
        attr("a3", 1, {"city": "Lyon"}, 3, 3),
    ])
    ch = rows_set(attribute_changes(df), ["name", "old_value", "value", "position"])
    assert ch == [("city", None, "Paris, France", 1), ("city", "Paris, France", "Lyon", 3)]


def test_changelog_bucket_boundaries(spark):
    rows = []
    vals = ["a", "a", "b", "b", "b", "c", "a", "a", "d"]
    for i, v in enumerate(vals):
        rows.append(attr(f"r{i}", 1, {"k": v}, i, i * 10))
    df = recs(spark, rows)
    whole = rows_set(attribute_changes(df))
    for span in (1, 7, 10, 25, 1000):
        assert rows_set(attribute_changes(df, span=span)) == whole
    assert [r[3] for r in sorted(whole, key=lambda r: r[5])] == ["a", "b", "c", "a", "d"]
    assert [r[2] for r in sorted(whole, key=lambda r: r[5])] == [None, "a", "b", "c", "a"]


def test_changelog_prior_value(spark):
    df = recs(spark, [attr("a1", 1, {"k": "x"}, 1, 1), attr("a2", 1, {"k": "y"}, 2, 2)])
    prior = spark.createDataFrame([(1, "k", "x")], "user_id long, key string, value string")
    got = rows_set(attribute_changes(df, prior=prior), ["old_value", "value"])
    assert got == [("x", "y")]


def test_page_past_end_reports_page_one(spark):
    df = spark.createDataFrame([(i, "") for i in range(1, 6)], "id long, attributes string")
    rows, meta = paging.list_profiles(df, page=9, per_page=2)
    assert rows.count() == 0
    assert meta.first().asDict() == {"page": 1, "per_page": 2, "total": 5}
    rows, meta = paging.list_profiles(df, page=2, per_page=2)
    assert [r.id for r in rows.collect()] == [3, 4]
    assert meta.first().page == 2
    rows, meta = paging.list_profiles(df, page=-1, per_page="x")   # defaults 1 / 25
    assert rows.count() == 5 and meta.first().per_page == 25
    assert [r.id for r in paging.page_after(df, 3, 10).collect()] == [4, 5]


def test_row_last_arrival_overwrites_absent_keys(spark):
    df = recs(spark, [attr("a1", 1, {"email": "e", "ip": "1"}, 9, 1),
                      attr("a2", 1, {"first_name": "f"}, 1, 2)])
    r = row_last_arrival(df).first()
    assert (r.email, r.first_name, r.last_name, r.ip) == ("", "f", "", "")


def test_profile_invariant_to_order_partitions_and_duplicates(spark):
    import random
    rnd = random.Random(3)
    rows = []
    pos = 0
    for u in range(1, 6):
        for j in range(20):
            pos += 1
            if rnd.random() < 0.5:
                rows.append(attr(f"a{pos}", u, {rnd.choice("xyz"): str(rnd.randint(0, 9))},
                                 rnd.randint(0, 10**6), pos))
            else:
                rows.append(event(f"e{pos}", u, rnd.choice(["click", "view"]), pos, pos))
    base = profiles(dedup_records(recs(spark, rows)))
    want = rows_set(base.select("id", F.to_json("attributes"), F.to_json("events")))
    for seed in range(3):
        shuffled = rows[:] + rnd.sample(rows, 15)   # exact duplicate copies
        rnd.shuffle(shuffled)
        df = recs(spark, shuffled).repartition(seed + 2)
        got = profiles(dedup_records(df))
        assert rows_set(got.select("id", F.to_json("attributes"), F.to_json("events"))) == want


def test_changelog_range_buckets_split_a_hot_key(spark):
    rows = [attr(f"r{i}", 1, {"k": "ab"[(i // 3) % 2]}, i % 17, i) for i in range(300)]
    df = recs(spark, rows)
    want = rows_set(attribute_changes(df, order="event_time"))
    got = attribute_changes(df, order="event_time", balance="range", buckets=6)
    assert rows_set(got) == want
    # the one hot (user, key) was spread over several buckets
    from eventfold.operators.attributes import attribute_assertions
    from eventfold.operators.changes import _range_buckets
    b = _range_buckets(attribute_assertions(df), [F.col("timestamp"), F.col("position")], 6)
    assert b.select("_b").distinct().count() >= 4


def test_profile_ignores_null_values_and_counts_empty_records(spark):
    df = recs(spark, [attr("a1", 1, {"k": "v", "j": "x"}, 1, 1),
                      attr("a2", 1, {"k": None}, 9, 2),      # newer NULL asserts nothing
                      attr("a3", 2, {}, 7, 3)])              # no entries: still a customer
    p = {r.id: r for r in profiles(df).collect()}
    assert p[1].attributes == {"j": "x", "k": "v"}
    assert p[1].last_updated == 9                            # newest attributes record
    assert p[2].attributes == {} and p[2].last_updated == 7


def test_attribute_state_modes(spark):
    from eventfold import attribute_state
    df = recs(spark, [attr("a1", 1, {"email": "new"}, 9, 1), attr("a2", 1, {"email": "old"}, 1, 2)])
    assert attribute_state(df).first().value == "new"
    assert attribute_state(df, mode="row_last_arrival").first().email == "old"
