"""Every registered query against its SQL on DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

QUERIES = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return compare.oracle(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    got = compare.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    cur = duck.execute(SQL[name])
    want = compare.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert compare.difference(got, want) is None


def test_entry(spark):
    assert entry(spark).count() == 5
