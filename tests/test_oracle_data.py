"""The adapter's records can tell a right query from a plausible wrong one.

All in DuckDB at sf0.01, on the oracle's own SQL: where two rules must differ,
the data makes them differ, and each status and reason occurs.
"""

import pytest

from eventfold.plans.oracle import ORACLE, with_records
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def con():
    from tools.oracle_check import duck
    return duck(SF_CHECK)


def one(con, sql):
    return con.execute(sql).fetchone()[0]


def test_newest_value_is_not_the_last_to_arrive(con):
    assert one(con, with_records("""
        SELECT count(*) FROM latest JOIN (
          SELECT user_id, key, max_by(value, position) AS last FROM assertions GROUP BY ALL) USING (user_id, key)
        WHERE value <> last""")) > 0


def test_arrival_and_event_time_changelogs_differ(con):
    assert one(con, f"""
        SELECT count(*) FROM (SELECT * FROM ({ORACLE['attribute_changes']}) EXCEPT
                              SELECT * FROM ({ORACLE['attribute_changes_event_time']}))""") > 0


def test_copies_cross_the_merge_cut_and_the_micro_batches(con):
    for parts in (2, 4):
        assert one(con, with_records(f"""
            SELECT count(*) FROM (SELECT id FROM recs GROUP BY id
              HAVING count(DISTINCT position * {parts} // ((SELECT max(position) FROM recs) + 1)) > 1)""")) > 0


def test_nulls_missing_times_and_several_keys_occur(con):
    for where in ("aval IS NULL", "timestamp IS NULL", "akey2 IS NOT NULL", "user_id IS NULL"):
        assert one(con, with_records(f"SELECT count(*) FROM recs WHERE {where}")) > 0, where


def test_a_user_has_events_only(con):
    assert one(con, with_records("SELECT count(DISTINCT user_id) FROM counts WHERE user_id NOT IN (SELECT user_id FROM lu)")) > 0


def test_every_reconcile_status_occurs(con):
    found = {r[0] for r in con.execute(f"SELECT DISTINCT status FROM ({ORACLE['reconcile_customers']})").fetchall()}
    assert found == {"missing_customer", "extra_customer", "missing_key", "extra_key", "mismatch"}
    kinds = {r[0] for r in con.execute(f"SELECT DISTINCT kind FROM ({ORACLE['reconcile_observed']})").fetchall()}
    assert kinds == {"attribute", "event"}


def test_quarantine_reasons_orphans_and_summary_attributes_occur(con):
    assert one(con, f"SELECT count(DISTINCT reason) FROM ({ORACLE['ndjson_quarantine']})") == 8
    assert one(con, f"SELECT count(*) FROM ({ORACLE['orphan_events']})") > 0
    assert one(con, f"SELECT count(*) FROM ({ORACLE['summary_roundtrip']}) WHERE kind = 'attribute'") > 0
