"""Each registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb
import pytest

from sensorloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows, name
        return
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at, other = [df.columns.index(c) for c in columns], [want.columns.index(c) for c in columns]
    got = Counter(tuple(plain(r[i]) for i in at) for r in rows)
    expected = Counter(tuple(plain(r[i]) for i in other) for r in want.fetchall())
    assert got == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
