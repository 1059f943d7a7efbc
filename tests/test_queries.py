"""Every named query against its SQL on the smallest tables."""

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from breezeline.plans import catalog, oracle  # noqa: E402
from oracle_check import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
# the streaming jobs have their own tests; at full length they run in oracle_check
NAMES = [n for n in contract.oracle_sql() if not n.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.ORACLE)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, SF_DIR, contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None
