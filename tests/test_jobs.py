"""End-to-end: ingest NDJSON, then verify against an expected summary."""

import json
import os

from eventfold.jobs import ingest, read_profiles_json, verify


def _lines():
    recs = [
        {"id": "a1", "type": "attributes", "user_id": "1", "timestamp": 200,
         "data": {"email": "new@x", "city": "rome"}},
        {"id": "e1", "type": "event", "name": "click", "user_id": "1", "timestamp": 201, "data": {"p": "q"}},
        {"id": "e1", "type": "event", "name": "click", "user_id": "1", "timestamp": 201, "data": {"p": "q"}},
        {"id": "a2", "type": "attributes", "user_id": "1", "timestamp": 100, "data": {"email": "old@x"}},
        {"id": "e2", "type": "event", "name": "view", "timestamp": 5},                 # anonymous
        {"id": "a3", "type": "attributes", "user_id": "10", "timestamp": 1, "data": {"first_name": "ann"}},
        {"id": "e3", "type": "event", "name": "buy", "user_id": "2", "timestamp": 3},  # no customer
    ]
    return [json.dumps(r) for r in recs] + ['{"id": 5}', "not json"]


def test_ingest_then_verify(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in.ndjson")
    with open(src, "w") as f:
        f.write("\n".join(_lines()) + "\n")
    out = os.path.join(tmpdir_fresh, "out")
    counts = ingest(spark, src, out)
    assert counts == {"records": 6, "quarantined": 2}
    prof = {r.id: r for r in read_profiles_json(spark, f"{out}/profiles").collect()}
    assert set(prof) == {1, 10}
    assert prof[1].attributes == {"email": "new@x", "city": "rome"} and prof[1].events == {"click": 1}
    summary_lines = [r.value for r in spark.read.text(f"{out}/summary").collect()]
    assert summary_lines == ["1,city=rome,email=new@x,click=1", "10,first_name=ann,"]

    expected = os.path.join(tmpdir_fresh, "expected.txt")
    with open(expected, "w") as f:
        f.write("1,city=rome,email=new@x,click=1\n10,first_name=ann,\n")
    assert verify(spark, out, expected) == 0

    with open(expected, "w") as f:
        f.write("1,city=paris,email=new@x,click=2\n3,\n")
    assert verify(spark, out, expected) == 4   # city, click, missing 3, extra 10
    assert spark.read.parquet(f"{out}/changes").count() == 4


def test_a_value_with_a_comma_is_a_difference(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in.ndjson")
    with open(src, "w") as f:
        f.write(json.dumps({"id": "a", "type": "attributes", "user_id": "1", "timestamp": 1,
                            "data": {"city": "Rome, IT", "email": "real@x"}}) + "\n")
    out = os.path.join(tmpdir_fresh, "out")
    ingest(spark, src, out)
    expected = os.path.join(tmpdir_fresh, "expected.txt")
    with open(expected, "w") as f:
        f.write("1,city=Rome, IT,email=WRONG@x\n")
    assert verify(spark, out, expected) > 0


def test_cli_entry_points(spark, tmpdir_fresh):
    from eventfold.jobs import main
    src = os.path.join(tmpdir_fresh, "in.ndjson")
    with open(src, "w") as f:
        f.write("\n".join(_lines()) + "\n")
    out = os.path.join(tmpdir_fresh, "out")
    assert main(["ingest", src, out]) == 0
    expected = os.path.join(tmpdir_fresh, "expected.txt")
    with open(expected, "w") as f:
        f.write("1,city=rome,email=new@x,click=1\n10,first_name=ann,\n")
    assert main(["verify", out, expected]) == 0
    with open(expected, "w") as f:
        f.write("1,city=rome,email=new@x,click=7\n10,first_name=ann,\n")
    assert main(["verify", out, expected]) == 1


class LostBeforeWriting:
    """A ledger whose run ends before it is written."""

    def __init__(self, df):
        self.collect = df.collect

    def withColumn(self, *_):  # noqa: N802
        raise RuntimeError("lost")


def test_more_reads_what_was_added_and_repeats_safely(spark, tmpdir_fresh, monkeypatch):
    import pytest

    from eventfold import attribute_changes, dedup_records, event_counts, jobs
    from eventfold.jobs import ingest_more
    from eventfold.operators.store import Store
    from eventfold.sources import ndjson
    from eventfold.sources.ndjson import read_lines
    from eventfold.sources.records import parse_lines
    from tests.helpers import rows_set
    src, out = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out"
    os.makedirs(src)
    lines = _lines()

    def add(name, some):
        with open(f"{src}/{name}", "a") as f:
            f.write("".join(x + "\n" for x in some))

    add("b", lines[:4])
    assert ingest_more(spark, src, out) == {"version": 1, "quarantined": 0}
    add("b", lines[4:])
    add("a", [lines[1], json.dumps({"id": "a4", "type": "attributes", "user_id": "1", "timestamp": 50, "data": {"email": "late@x"}})])
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(jobs, "ledger", lambda *a: LostBeforeWriting(ndjson.ledger(*a)))
        ingest_more(spark, src, out)
    assert ingest_more(spark, src, out) == {"version": 2, "quarantined": 2}
    assert ingest_more(spark, src, out) == {"version": 3, "quarantined": 0}
    store = Store(spark, f"{out}/store")
    d = dedup_records(parse_lines(read_lines(spark, src))[0].drop("source"))
    assert rows_set(store.read("counts")) == rows_set(event_counts(d))
    got = {(r.name, r.old_value, r.value) for r in store.changes().collect() if r.user_id == 1}
    assert got == {("email", None, "new@x"), ("city", None, "rome"), ("email", "new@x", "old@x"), ("email", "old@x", "late@x")}
    assert attribute_changes(d).count() == store.last_change()
