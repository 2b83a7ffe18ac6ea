"""S7 fact sink layout and session sizing."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from eventfold.session import scale_conf
from eventfold.sources.sinks import store_records
from tests.helpers import attr, event, recs


def test_fact_sink_partitions_prune_by_date(spark, tmpdir_fresh):
    day = 86400
    df = recs(spark, [event("e1", 1, "click", 10 * day + 5, 1), event("e2", 1, "view", 11 * day + 7, 2),
                      attr("a1", 1, {"k": "v"}, 11 * day + 9, 3)])
    path = f"{tmpdir_fresh}/records"
    slice_ = store_records(df, path, load="l1", mode="overwrite", by_date=True)
    assert slice_.count() == 3
    stored = spark.read.parquet(path)
    one_day = stored.filter(F.col("event_date") == F.lit("1970-01-12").cast("date"))
    buf = io.StringIO()
    with redirect_stdout(buf):
        one_day.explain()
    assert "PartitionFilters: [isnotnull(event_date" in buf.getvalue()
    assert sorted(r.id for r in one_day.collect()) == ["a1", "e2"]


def test_scale_conf_sizes_partitions():
    c = scale_conf(100 * 1024 ** 4)
    assert c["spark.sql.shuffle.partitions"] == "409600"          # follows the input, no cap
    assert scale_conf(50 * 1024 ** 3)["spark.sql.shuffle.partitions"] == "200"
    assert scale_conf(512 * 1024 ** 3)["spark.sql.shuffle.partitions"] == "2048"
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert c["spark.sql.files.maxPartitionBytes"] == "256m"
