"""Byte ranges: lines, positions, offsets and streams against plain file reading."""

import json
import os
import random

import pytest

from eventfold import attribute_changes, dedup_records
from eventfold.sources import ndjson
from eventfold.sources.records import parse_lines, raw_records, read_records
from tests.helpers import rows_set

# The two sample records of the input format.
SAMPLE = [{"id": "111-222-333", "type": "attributes", "user_id": "user-1", "data": {"name": "john doe", "city": "toronto"}, "timestamp": 1234567890},
          {"id": "123-456-789", "type": "event", "name": "signup", "user_id": "user-2", "data": {"random": "test"}, "timestamp": 1234567890}]


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


def expected(files):
    out, base = [], 0
    for name in sorted(files):
        at = 0
        for piece in files[name].splitlines(keepends=True) if b"\r" not in files[name] else files[name].replace(b"\r\n", b"\x01\n").split(b"\n"):
            if b"\x01" in piece or not piece.endswith(b"\n"):
                raise AssertionError("plain newlines only")
            at += len(piece)
            out.append((piece[:-1].decode(), name, base + at, at))
        base += len(files[name])
    return sorted(out)


def test_sample_records_come_out_unchanged(spark, tmpdir_fresh):
    lines = [json.dumps(r).encode() + b"\n" for r in SAMPLE]
    write(f"{tmpdir_fresh}/in", {"a.ndjson": b"".join(lines)})
    raw, bad = raw_records(ndjson.read_lines(spark, f"{tmpdir_fresh}/in"))
    rows = sorted(raw.collect(), key=lambda r: r.position)
    assert bad.count() == 0
    assert [{k: v for k, v in r.asDict().items() if k in SAMPLE[0] | SAMPLE[1] and v is not None} for r in rows] == SAMPLE
    assert [r.position for r in rows] == [len(lines[0]), len(lines[0]) + len(lines[1])]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_every_line_once_at_any_range(spark, tmpdir_fresh, monkeypatch, size):
    monkeypatch.setattr(ndjson, "READ", 16)
    r = random.Random(size)
    files = {f"p-{i}": b"".join(("é" * r.randint(0, 20)).encode() + b"\n" for _ in range(40)) for i in range(3)} | {"empty": b"", "one": b"\n"}
    write(f"{tmpdir_fresh}/in", files | {"_SUCCESS": b"x\n", ".hidden": b"y\n"})
    parts = ndjson.ranges({}, ndjson.listed(f"{tmpdir_fresh}/in"), 0, size)
    got = [x for p in parts for b in ndjson.lines(p) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted((v, os.path.basename(s), p, f) for v, s, p, f in got) == expected(files)


def test_last_line_carriage_returns_and_compressed(spark, tmpdir_fresh):
    write(f"{tmpdir_fresh}/in", {"a": b"x\r\ny\n\nlast"})
    rows = ndjson.read_lines(spark, f"{tmpdir_fresh}/in", range_bytes=2).orderBy("position").collect()
    assert [(r.value, r.position) for r in rows] == [("x", 3), ("y", 5), ("", 6), ("last", 10)]
    write(f"{tmpdir_fresh}/gz", {"a.gz": b"x"})
    with pytest.raises(ValueError, match="compressed"):
        ndjson.listed(f"{tmpdir_fresh}/gz")


def test_resume_reads_only_new_bytes(spark, tmpdir_fresh):
    folder = f"{tmpdir_fresh}/in"
    old = {"a": b"1\n22\n333\n", "b": b"4\n5\n"}
    write(folder, old)
    first = ndjson.read_lines(spark, folder)
    ledger = ndjson.ledger(spark, folder, first.where("value <> '333' and source like '%/a'"))
    assert sorted((r.source[-1], r.size, r.offset) for r in ledger.collect()) == [("a", 9, 5), ("b", 4, 0)]
    full = ndjson.ledger(spark, folder)
    full.write.parquet(f"{tmpdir_fresh}/ledger")
    write(folder, {"a": old["a"] + b"6\n", "0": b"7\n"})  # one grew, one came before it in path order
    stored = spark.read.parquet(f"{tmpdir_fresh}/ledger")
    assert sorted(r.value for r in ndjson.resume(spark, folder, stored).collect()) == ["6", "7"]
    seen = {r.source: r.offset for r in stored.collect()}
    assert sum(p.end - p.start for p in ndjson.ranges(seen, ndjson.listed(folder), 0, 1 << 20)) == 4
    assert sorted(r.value for r in ndjson.resume(spark, folder, ledger).collect()) == ["333", "4", "5", "6", "7"]
    write(folder, {"b": b"9\n"})  # replaced by a shorter one
    assert sorted(r.value for r in ndjson.resume(spark, folder, stored).collect()) == ["6", "7", "9"]


def test_stream_keeps_arrival_order_and_resumes(spark, tmpdir_fresh):
    folder = f"{tmpdir_fresh}/in"

    def rec(i, value):
        return json.dumps({"id": i, "type": "attributes", "user_id": "1", "data": {"k": value}, "timestamp": 1}).encode() + b"\n"

    write(folder, {"p0": rec("z", "first") + rec("a", "second"), "p1": rec("m", "third") + rec("b", "third")})
    got = []

    def run(**options):
        def sink(batch, _):
            got.extend((r.value[8:9], os.path.basename(r.source), r.position) for r in batch.orderBy("position").collect())
        q = ndjson.stream_lines(spark, folder, **options).writeStream.option("checkpointLocation", f"{tmpdir_fresh}/ckpt") \
            .foreachBatch(sink).trigger(availableNow=True).start()
        q.awaitTermination()

    run(tail=True)
    want = [(r.value[8:9], os.path.basename(r.source), r.position) for r in ndjson.read_lines(spark, folder).orderBy("position").collect()]
    assert [g[0] for g in got] == ["z", "a", "m", "b"] and got == want
    write(folder, {"p0": rec("z", "first") + rec("a", "second") + rec("c", "x") + b'{"id": "cut'})
    run(tail=True)
    assert [g[:2] for g in got[4:]] == [("c", "p0")] and got[4][2] > got[3][2]
    changes = attribute_changes(dedup_records(parse_lines(ndjson.read_lines(spark, folder))[0].drop("source")))
    assert ("first", "second") in {(r.old_value, r.value) for r in changes.collect()}


def test_same_records_as_the_text_scan(spark, tmpdir_fresh):
    r = random.Random(3)
    files = {f"part-{i}": b"".join(json.dumps({"id": f"{i}-{j}", "type": "event", "name": "é" * r.randint(0, 9)}).encode() + b"\n" for j in range(50)) for i in range(3)}
    write(f"{tmpdir_fresh}/in", files)
    a, _ = read_records(spark, f"{tmpdir_fresh}/in")
    b, _ = parse_lines(ndjson.read_lines(spark, f"{tmpdir_fresh}/in", range_bytes=100))
    assert rows_set(a, ["id", "name", "position"]) == rows_set(b, ["id", "name", "position"])


def test_small_ranges_read_their_own_bytes_and_share_partitions(tmpdir_fresh, monkeypatch):
    folder = f"{tmpdir_fresh}/in"
    files = {f"p-{i:02d}": b"".join(b"%d-%d%s\n" % (i, j, b"x" * (j % 90)) for j in range(4000)) for i in range(5)} | {"long": b"y" * 300_000 + b"\nz\n"}
    write(folder, files)
    total = sum(map(len, files.values()))
    read = 0

    class Counted:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            nonlocal read
            data = self.f.read(n)
            read += len(data)
            return data

    plain = ndjson.range_lines
    monkeypatch.setattr(ndjson, "range_lines", lambda part, f: plain(part, Counted(f)))
    monkeypatch.setattr(ndjson, "TASK", 400_000)
    tasks = ndjson.Reader({"path": folder, "rangebytes": str(64 * 1024)}).partitions()
    assert len(tasks) <= 2 * total // 400_000 + 1  # as many as the bytes need, not one a range
    assert [p for t in tasks for run in t.runs for p in ndjson.cut(run, t.size)] == ndjson.ranges({}, ndjson.listed(folder), 0, 64 * 1024)
    got = [x for t in tasks for b in ndjson.task_lines(t) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted((v, os.path.basename(s), p, f) for v, s, p, f in got) == expected(files)
    assert read < 2 * total + 300_000  # READ, 4 MB, is more than the whole input


def test_ordered_files_hold_a_bounded_number_of_rows(spark, tmpdir_fresh, monkeypatch):
    from eventfold.plans import queries

    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01' AS ts, id % 7 AS user_id, 'view' AS event_type, '{\"k\": 1}' AS props FROM range(2000)") \
        .coalesce(1).write.parquet(f"{tmpdir_fresh}/events.parquet")
    monkeypatch.setattr(queries, "ORDERED_EVENTS", 250)
    path = queries._ordered_ndjson_path(spark, tmpdir_fresh)
    files = ndjson.listed(path)
    assert len(files) >= 8 and max(files.values()) < sum(files.values()) // 4
    first, end = {}, {}
    for r in ndjson.read_lines(spark, path).orderBy("position").collect():
        if json.loads(r.value)["id"].startswith("a-"):
            first.setdefault(r.source, int(json.loads(r.value)["id"][2:]))
            end[r.source] = int(json.loads(r.value)["id"][2:])
    order = sorted(first)
    assert all(end[x] < first[y] for x, y in zip(order[:-1], order[1:], strict=True))
