"""Physical-plan properties that the design relies on at scale."""

import io
from contextlib import redirect_stdout

import pytest

from eventfold.plans.queries import QUERIES
from tests.conftest import SF_SMALL

BATCH = [n for n in QUERIES if not n.startswith("stream_")]


def plan_of(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairs_no_row_udfs(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)


def test_flagship_scans_are_pruned(spark):
    plan = plan_of(QUERIES["customer_profile"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in plan
    assert "ReadSchema: struct<c_custkey:bigint>" in plan     # 1 of 5 customer columns
    assert "value:double" not in plan                          # unused events column not read


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["customer_lookup"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,7)" in plan


@pytest.mark.parametrize("name, partial", [
    ("dedup_events", "partial_min_by"),
    ("event_counts", "partial_count"),
    ("latest_attributes", "partial_max_by"),
    ("key_uniqueness", "partial_count"),
    ("customer_profile", "partial_max_by"),
    ("row_last_arrival", "partial_max_by"),
])
def test_hot_keys_combine_before_the_shuffle(spark, name, partial):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert partial in plan, name


def test_changelog_shuffles_assertions_once(spark):
    plan = plan_of(QUERIES["attribute_changes"](spark, SF_SMALL))
    # one exchange on (user_id, key, bucket) for the rows; the bucket tails
    # are a partial aggregate, not a second copy of the rows
    assert plan.count("Window") >= 2
    assert "partial_max_by" in plan


def test_lookups_drop_other_customers_before_the_fold(spark):
    """The semi join with the wanted customers is below the last aggregate or window."""
    import io
    from contextlib import redirect_stdout

    from eventfold.plans.queries import QUERIES
    for name, above in (("customer_lookup", "Aggregate"), ("customer_changes", "Window")):
        buf = io.StringIO()
        with redirect_stdout(buf):
            QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        plan = buf.getvalue()
        assert 0 <= plan.index(above) < plan.index("LeftSemi"), name


def test_counts_leave_the_payload_out_of_dedup(spark):
    """What is sorted and shuffled by id has no data, unless a query needs it."""
    def above_adapter(name):
        return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")[0]
    assert "data" not in above_adapter("event_counts")
    assert "data" in above_adapter("latest_attributes")
