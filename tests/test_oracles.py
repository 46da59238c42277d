"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, connect

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf, duck):
    assert compare(QUERIES[name](spark, sf), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert {"anomaly_score", "is_anomaly", "severity"} <= set(df.columns)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 120
