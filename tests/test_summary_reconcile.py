"""S5/S6 summary round trip and J8/U1/U2 reconcile."""

from pyspark.sql import functions as F

from eventfold.operators.reconcile import reconcile
from eventfold.sources.summary import (
    parse_summary,
    read_summary,
    summary_lines,
    summary_profiles,
    write_summary,
)
from tests.helpers import rows_set

PROFILE = "id long, attributes map<string,string>, events map<string,bigint>"


def _profiles(spark, rows):
    return spark.createDataFrame(rows, PROFILE)


def test_summary_line_format_and_string_order(spark, tmpdir_fresh):
    p = _profiles(spark, [
        (2, {"email": "b@x", "city": "rome"}, {"click": 3}),
        (10, {"created_at": "1600000000"}, {}),
        (1, {}, {"view": 1, "buy": 2}),
    ])
    lines = {r.id_text: r.line for r in summary_lines(p).collect()}
    assert lines == {"2": "2,city=rome,email=b@x,click=3", "10": "10,created_at=1600000000,",
                     "1": "1,,buy=2,view=1"}
    out = f"{tmpdir_fresh}/summary"
    write_summary(p, out)
    text = [r.value for r in spark.read.text(out).collect()]
    assert [t.split(",")[0] for t in text] == ["1", "10", "2"]


def test_summary_round_trip(spark, tmpdir_fresh):
    p = _profiles(spark, [
        (1, {"email": "a@x", "created_at": "1600000000", "ip": "1.2.3.4"}, {"click": 2}),
        (2, {"first_name": "Ann"}, {}),
        (3, {}, {}),
    ])
    out = f"{tmpdir_fresh}/s"
    write_summary(p, out)
    ids, long, bad = read_summary(spark, out)
    back = summary_profiles(ids, long)
    norm = lambda df: rows_set(df.select("id", F.to_json("attributes"), F.to_json("events")))
    assert bad.count() == 0
    assert norm(back) == norm(p)


def test_summary_quarantine_and_routing(spark):
    lines = spark.createDataFrame([("x,a=b",), ("5,a=b,c",), ("6,a=b=c",), ("7,,a=1,created_at=9,b=x",),
                                   ("8",)], "value string")
    ids, long, bad = parse_summary(lines)
    assert sorted(r.id for r in ids.collect()) == [7, 8]
    assert bad.count() == 3
    got = rows_set(long)
    assert got == [(7, "attribute", "b", "x"), (7, "attribute", "created_at", "9"), (7, "event", "a", "1")]


def test_reconcile_reports_every_status(spark):
    expected = _profiles(spark, [
        (1, {"email": "a"}, {"click": 1}),
        (2, {"email": "b", "ip": "1"}, {"view": 2}),
        (3, {}, {}),
    ])
    actual = _profiles(spark, [
        (2, {"email": "B", "city": "x"}, {"view": 2, "buy": 1}),
        (3, {}, {}),
        (4, {}, {"click": 9}),
    ])
    got = rows_set(reconcile(actual, expected), ["id", "kind", "key", "expected", "actual", "status"])
    assert got == [
        (1, "customer", None, None, None, "missing_customer"),
        (2, "attribute", "city", None, "x", "extra_key"),
        (2, "attribute", "email", "b", "B", "mismatch"),
        (2, "attribute", "ip", "1", None, "missing_key"),
        (2, "event", "buy", None, "1", "extra_key"),
        (4, "customer", None, None, None, "extra_customer"),
    ]
    assert reconcile(expected, expected).count() == 0


def test_summary_repeated_keys(spark):
    lines = spark.createDataFrame([("1,a=x,a=y,click=1,click=2",), ("2,b=p",), ("2,b=q,c=r",)], "value string")
    ids, long, bad = parse_summary(lines)
    assert rows_set(long.filter("id = 1")) == [(1, "attribute", "a", "y"), (1, "event", "click", "2")]
    p = {r.id: r for r in summary_profiles(ids, long).collect()}
    assert p[1].attributes == {"a": "y"} and p[1].events == {"click": 2}
    assert p[2].attributes == {"b": "q", "c": "r"}


def test_long_lines_keep_the_later_of_repeated_keys(spark):
    fields = [f"k{i % 700}=v{i}" for i in range(20_000)] + [f"k{i}={i}" for i in range(5)] + ["k1=7", "", "k2=x"]
    lines = spark.createDataFrame([("1," + ",".join(fields),), ("2,a=1,a=b,a=2",)], "value string")
    _, long, bad = parse_summary(lines)
    want = {}
    for f in fields:
        if f:
            k, v = f.split("=")
            want["event" if v.isdigit() else "attribute", k] = v
    assert bad.count() == 0
    got = long.collect()
    assert sorted((r.kind, r.key, r.value) for r in got if r.id == 1) == sorted((*k, v) for k, v in want.items())
    assert sorted((r.kind, r.key, r.value) for r in got if r.id == 2) == [("attribute", "a", "b"), ("event", "a", "2")]
