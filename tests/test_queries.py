"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from spanwatt.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "events")


def plain(x):
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(catalog.SQL[name])
    columns = sorted(d[0] for d in want.description)
    place = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(repr(tuple(plain(r[k]) for k in place)) for r in want.fetchall())
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect()) == expected


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
