"""Every registered query against its SQL at the smallest scale."""

import pytest
from check_queries import compare, connect
from conftest import SF_DIR

import __spark_entry__ as entry

from studyframe.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert frame.columns and frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() == 18
    for r in frame.collect():
        assert r.med_lo <= r.med_mid <= r.med_hi and r.p05_mid <= r.med_mid <= r.p95_mid
