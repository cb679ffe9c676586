"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from merchantry.plans.registry import oracle_sql, queries

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    if name in SQL:
        problem = compare(df, con, SQL[name])
        assert problem == "", problem  # no rows on both sides is a problem too
    else:
        assert df.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(queries())
