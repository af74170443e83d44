"""Every registered query with checking SQL, on the smallest tables."""

import pytest

import check
from vigilframe import plans

# The training queries are covered by test_models.
ROWS_ONLY = ["c9_dashboard_composite"]


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, small, con, name):
    got = plans.QUERIES[name](spark, small).toArrow()
    want = con.execute(plans.ORACLES[name]).to_arrow_table()
    assert check.compare(got, want) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_yields_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["minute", "count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
