"""Every registered query against its DuckDB oracle, and the entry smoke check."""

import pytest

from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["id", "attributes", "events", "n_events", "last_updated"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    from __spark_entry__ import oracle_sql
    from eventfold.plans.queries import QUERIES
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("sf_dir", [SF_SMALL])
def test_queries_match_oracle(spark, sf_dir):
    from tools.oracle_check import compare
    from eventfold.plans.queries import QUERIES
    res = compare(spark, sf_dir, names=sorted(QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "OK"}
    assert not bad, bad
