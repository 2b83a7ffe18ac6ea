"""Property tests: Spark operators against brute force on random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventfold import attribute_changes, dedup_records, event_counts, latest_attributes
from eventfold.sources.summary import parse_summary, summary_lines
from tests.helpers import attr, event, recs, rows_set

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])

assertion = st.tuples(st.integers(1, 3), st.sampled_from("kjx"), st.sampled_from(["a", "b", "c", ""]),
                      st.integers(0, 5))


@SETTINGS
@given(rows=st.lists(assertion, min_size=1, max_size=40), span=st.integers(1, 50),
       order=st.sampled_from(["arrival", "event_time"]), balance=st.sampled_from(["span", "range"]))
def test_changelog_matches_brute_force(spark, rows, span, order, balance):
    data = [attr(f"r{i}", u, {k: v}, ts, i + 1) for i, (u, k, v, ts) in enumerate(rows)]
    got = rows_set(attribute_changes(recs(spark, data), order=order, span=span, balance=balance,
                                     buckets=span % 7 + 1),
                   ["user_id", "name", "old_value", "value", "position"])
    seq = sorted(((u, k, v, ts, i + 1) for i, (u, k, v, ts) in enumerate(rows)),
                 key=(lambda r: r[4]) if order == "arrival" else (lambda r: (r[3], r[4])))
    last, want = {}, []
    for u, k, v, ts, pos in seq:
        prev = last.get((u, k))
        if prev != v or (u, k) not in last:
            want.append((u, k, prev, v, pos))
        last[(u, k)] = v
    key = lambda t: tuple((x is not None, x) for x in t)
    assert got == sorted(want, key=key)


@SETTINGS
@given(rows=st.lists(assertion, min_size=1, max_size=40), parts=st.integers(1, 6))
def test_latest_attributes_matches_brute_force(spark, rows, parts):
    data = [attr(f"r{i}", u, {k: v}, ts, i + 1) for i, (u, k, v, ts) in enumerate(rows)]
    got = rows_set(latest_attributes(recs(spark, data).repartition(parts)), ["user_id", "key", "value"])
    best = {}
    for i, (u, k, v, ts) in enumerate(rows):
        if (u, k) not in best or (ts, i + 1) > best[(u, k)][0]:
            best[(u, k)] = ((ts, i + 1), v)
    assert got == sorted((u, k, v) for (u, k), (_, v) in best.items())


@SETTINGS
@given(events=st.lists(st.tuples(st.integers(0, 9), st.integers(1, 3), st.sampled_from(["view", "buy"])),
                       min_size=1, max_size=30))
def test_counts_ignore_copies(spark, events):
    # Several rows may share an id (copies); each id counts once.
    first = {}
    for i, (rid, u, name) in enumerate(events):
        first.setdefault(rid, (u, name))
    data = [event(f"e{rid}", *first[rid], ts=0, pos=i + 1) for i, (rid, _, _) in enumerate(events)]
    got = rows_set(event_counts(dedup_records(recs(spark, data))))
    want = {}
    for u, name in first.values():
        want[(u, name)] = want.get((u, name), 0) + 1
    assert got == sorted((u, n, c) for (u, n), c in want.items())


text = st.text(alphabet="abcxyz._-@ ", min_size=0, max_size=6)


@SETTINGS
@given(profiles=st.dictionaries(
    st.integers(1, 10**6),
    st.tuples(st.dictionaries(st.text(alphabet="abcdef_", min_size=1, max_size=5), text, max_size=4),
              st.dictionaries(st.text(alphabet="ghij", min_size=1, max_size=4), st.integers(1, 99),
                              max_size=3)),
    min_size=1, max_size=6))
def test_summary_round_trip(spark, profiles):
    rows = [(i, a, e) for i, (a, e) in profiles.items()]
    df = spark.createDataFrame(rows, "id long, attributes map<string,string>, events map<string,bigint>")
    ids, long, bad = parse_summary(summary_lines(df).select(F.col("line").alias("value")))
    assert bad.count() == 0
    assert sorted(r.id for r in ids.collect()) == sorted(profiles)
    want = sorted([(i, "attribute", k, v) for i, (a, _) in profiles.items() for k, v in a.items()]
                  + [(i, "event", k, str(n)) for i, (_, e) in profiles.items() for k, n in e.items()])
    assert rows_set(long, ["id", "kind", "key", "value"]) == want
