"""Every registered query at the smallest scale: the rows equal those of its SQL."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, engine
from shelfgrade.staging import scope

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return engine(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    with scope(spark):
        complaint, rows = compare(con, name, QUERIES[name](spark, FOLDER), ORACLES.get(name))
    assert not complaint
    assert rows >= 0


def test_entry(spark):
    rows = {r["nutriscore_grade"]: r["n"] for r in entry.entry(spark).collect()}
    assert set(rows) == set("abcde") and sum(rows.values()) > 0
