"""Every registered query of the audit engine against an outside SQL engine."""

import pytest
from compare import difference, outside_engine

import __spark_entry__ as entry
from rivulint.checks.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return outside_engine(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, engine, name):
    assert difference(QUERIES[name](spark, SF_DIR), engine, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r.language for r in rows] == sorted(r.language for r in rows)
    assert all(r.total == r.critical + r.high + r.medium + r.low for r in rows)
