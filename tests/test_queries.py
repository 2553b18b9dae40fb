"""Every query outside the subpackage of corpus operators against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from reviewspark import catalog

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(BASE):
        c.execute(f"create view {file.split('.')[0]} as select * from '{BASE}/{file}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    try:
        f = float(x)
    except (TypeError, ValueError):
        return str(x)
    return None if math.isnan(f) else round(f, 8)


def in_order(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, BASE)
    want = con.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert in_order([tuple(r) for r in got.collect()], got.columns) == in_order(want.fetchall(), columns)
