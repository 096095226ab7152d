"""Every registered query against its DuckDB oracle (small scale; tests/run_parity.py
runs the same check at sf0.01, the driver's scale)."""

import pytest

import __spark_entry__ as E
from eventide.plans.catalog import REGISTRY as QUERIES
from eventide.plans.oracle import ORACLE
from parity import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF, con)
    assert r["schema_match"], r
    assert r["rows_match"], r
    assert r["value_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["src", "dst", "mean", "std_dev", "total_events", "days_with_events",
                          "recent_count", "recent_rate", "z_score", "is_anomaly"]
