"""Every library query against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from caseloc.plans import registry

DATA = os.environ.get("CASELOC_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, sql, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    text = registry.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    assert rows, "a check of nothing"
    found = sql.sql(text)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert ordered(rows) == ordered([[r[i] for i in places] for r in found.fetchall()])


def test_entry_and_names():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in registry.queries()
