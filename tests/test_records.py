"""S1-S4, P2, P14 and the edge lines of the reader."""

import json
import os

from pyspark.sql import functions as F

from eventfold.sources.records import parse_lines, read_records


def _write(path, payload: bytes):
    with open(path, "wb") as f:
        f.write(payload)


def test_round_trip_two_records_with_positions(spark, tmpdir_fresh):
    # The reference's unit test: two records, every field and Position.
    recs = [
        {"id": "111-222-333", "type": "attributes", "user_id": "1",
         "data": {"name": "john doe", "city": "toronto"}, "timestamp": 1234567890},
        {"id": "123-456-789", "type": "event", "name": "signup", "user_id": "2",
         "data": {"random": "test"}, "timestamp": 1234567890},
    ]
    payload, ends = b"", []
    for r in recs:
        payload += json.dumps(r).encode() + b"\n"
        ends.append(len(payload))
    p = os.path.join(tmpdir_fresh, "in.ndjson")
    _write(p, payload)
    valid, bad = read_records(spark, p)
    rows = sorted(valid.collect(), key=lambda r: r.position)
    assert bad.count() == 0
    assert [r.position for r in rows] == ends
    assert rows[0].id == "111-222-333" and rows[0].data == {"name": "john doe", "city": "toronto"}
    assert rows[1].name == "signup" and rows[1].user_id == 2 and rows[1].timestamp == 1234567890


def test_positions_exact_across_splits_crlf_and_files(spark, tmpdir_fresh):
    import random
    rnd = random.Random(7)
    expected = {}
    paths = []
    total = 0
    for fi in range(2):
        payload = b""
        for i in range(3000):
            rid = f"f{fi}-{i}"
            line = json.dumps({"id": rid, "type": "event", "name": "é" * rnd.randint(0, 30),
                               "timestamp": i}, ensure_ascii=False).encode()
            payload += line + (b"\r\n" if rnd.random() < 0.3 else b"\n")
            expected[rid] = total + len(payload)
        p = os.path.join(tmpdir_fresh, f"part-{fi}.ndjson")
        _write(p, payload)
        total += len(payload)
        paths.append(p)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        valid, bad = read_records(spark, tmpdir_fresh)
        got = {r.id: r.position for r in valid.select("id", "position").collect()}
        assert valid.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert bad.count() == 0
    assert got == expected


EDGE = [
    ('{"id":"a","data":{"k":1}}', False),
    ('{"id":"b","data":{"k":null}}', True),
    ('{"ID":"c","Data":{"k":"v"}}', False),
    ('{"id":"d","data":{"k":"1","k":"2"}}', False),
    ('{"id":"e"', False),
    ('', False),
    ('null', False),
    ('{"id":5}', False),
    ('{"id":"f","timestamp":"12"}', False),
    ('{"id":"g","timestamp":1.5}', False),
    ('{"id":"h","data":{"k":{"x":1}}}', False),
    ('{"id":"i","user_id":7}', False),
    ('[1]', False),
    ('{"id":"j"} trailing', False),
    ('{"id":"l","data":[]}', False),
    ('{"id":"m","data":{}}', True),
    ('{"id":"r","timestamp":1e3}', False),
    ('{"id":"s","user_id":" 5 "}', False),
    ('{"id":"t","user_id":"","type":null}', True),
    ('{"id":"u"},"x":{"y":1}', False),
    ('{"id":"v","user_id":"+42","timestamp":-5}', True),
]


def test_edge_lines_valid_or_quarantined(spark):
    df = spark.createDataFrame([(v,) for v, _ in EDGE], "value string")
    valid, bad = parse_lines(df)
    ok_ids = {r.id for r in valid.collect()}
    assert ok_ids == {"b", "m", "t", "v"}
    assert bad.count() == len(EDGE) - 4
    rows = {r.id: r for r in valid.collect()}
    assert rows["b"].data == {"k": None}
    assert rows["t"].user_id is None          # "" is anonymous
    assert rows["v"].user_id == 42 and rows["v"].timestamp == -5
    assert all(r.reason for r in bad.collect())


def test_resume_from_offset(spark, tmpdir_fresh):
    lines = [json.dumps({"id": f"x{i}", "type": "event", "name": "n"}) for i in range(5)]
    payload = ("\n".join(lines) + "\n").encode()
    p = os.path.join(tmpdir_fresh, "r.ndjson")
    _write(p, payload)
    first_two = len(("\n".join(lines[:2]) + "\n").encode())
    valid, _ = read_records(spark, p, start=first_two)
    assert sorted(r.id for r in valid.collect()) == ["x2", "x3", "x4"]


def test_uuid_option(spark):
    df = spark.createDataFrame([('{"id":"{6BA7B810-9DAD-11D1-80B4-00C04FD430C8}"}',),
                                ('{"id":"not-a-uuid"}',)], "value string")
    valid, bad = parse_lines(df, require_uuid=True, canonical_ids=True)
    assert [r.id for r in valid.collect()] == ["6ba7b8109dad11d180b400c04fd430c8"]
    assert bad.select(F.col("reason")).first().reason == "id is not a UUID"


def _ends(spark, path, **kw):
    valid, _ = read_records(spark, path, **kw)
    return {r.id: r.position for r in valid.select("id", "position").collect()}


def test_positions_of_compressed_marked_and_unended_files(spark, tmpdir_fresh):
    import gzip
    lines = [json.dumps({"id": f"g{i}", "type": "event", "name": "n" * (i % 7)}).encode() + b"\n" for i in range(500)]
    ends = {f"g{i}": sum(map(len, lines[:i + 1])) for i in range(len(lines))}
    p = os.path.join(tmpdir_fresh, "a.ndjson.gz")
    _write(p, gzip.compress(b"".join(lines)))
    assert _ends(spark, p) == ends
    assert set(_ends(spark, p, start=ends["g299"])) == {f"g{i}" for i in range(300, 500)}
    p = os.path.join(tmpdir_fresh, "b.ndjson")
    _write(p, b"\xef\xbb\xbf" + b"".join(lines))
    assert _ends(spark, p) == {k: v + 3 for k, v in ends.items()}
    _write(p + ".2", (b"".join(lines))[:-1])
    assert _ends(spark, p + ".2") == ends | {"g499": ends["g499"] - 1}


def test_resume_by_file_finds_a_new_earlier_file(spark, tmpdir_fresh):
    from eventfold.sources.records import lines_with_positions, reached
    folder = os.path.join(tmpdir_fresh, "in")
    os.mkdir(folder)
    line = lambda i: json.dumps({"id": i, "type": "event", "name": "n"}).encode() + b"\n"
    _write(os.path.join(folder, "b.ndjson"), line("b1") + line("b2"))
    rows = reached(lines_with_positions(spark, folder)).collect()
    at = spark.createDataFrame(rows, "source string, offset long")
    _write(os.path.join(folder, "a.ndjson"), line("a1") + line("a2"))
    _write(os.path.join(folder, "b.ndjson"), line("b1") + line("b2") + line("b3"))
    assert set(_ends(spark, folder, start=at)) == {"a1", "a2", "b3"}


def test_strict_integer_and_uuid_forms(spark):
    from eventfold.functions.expr import atoi, canonical_uuid, is_uuid
    texts = ["5", "5\n", " 5", "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "{}6-ba7b8109dad11d180b400c04fd430c8", "URN:UUID:6ba7b810-9dad-11d1-80b4-00c04fd430c8"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(atoi("t"), is_uuid("t"), canonical_uuid("t")).collect()
    assert [r[0] for r in rows] == [5, None, None, None, None, None]
    assert [r[1] for r in rows] == [False, False, False, True, False, True]
    assert rows[3][2] == rows[5][2] == "6ba7b8109dad11d180b400c04fd430c8" and rows[4][2] == texts[4]


def test_a_line_is_parsed_once(spark, capsys):
    from eventfold.sources.records import parse_lines, raw_records
    df = spark.createDataFrame([('{"id":"x","type":"event"}',), ("{",)], "value string").repartition(2)
    for make in (parse_lines, raw_records):
        for rows in make(df):
            assert rows.count() == 1
            rows.explain("extended")
            plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
            assert plan.lower().count("parsejson(") == 1
