"""Every registered query against its SQL, value by value, at the smallest scale."""

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW = {"p8_pipeline_search", "k13_search_on_cv_score", "pipeline"}  # each has a test of its own


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    assert verify.compare(spark, con, name, SF, QUERIES, ORACLES) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    d = entry.entry(spark)
    assert d.columns == ["event_type", "split", "rows", "mae", "mse"] and d.count() > 0
