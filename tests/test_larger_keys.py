"""Queries against their SQL on small tables whose keys are as large as those of big tables, and on odd rows."""

import datetime as dt

import duckdb
import pytest

from spanwatt.plans import catalog

T0 = dt.datetime(2024, 1, 1)


def tables(folder, **rows) -> str:
    """rows: for each table the SQL of its rows."""
    for name, text in rows.items():
        duckdb.execute(f"copy ({text}) to '{folder}/{name}.parquet'")
    return str(folder)


def agrees(spark, folder: str, name: str, **rows) -> int:
    sf = tables(folder, **rows)
    db = duckdb.connect()
    for t in rows:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    expected = sorted(repr(tuple(r)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, sf).select(columns).collect()) == expected
    return len(expected)


def events(*rows) -> str:
    """rows: user, minutes, direction."""
    values = ", ".join(f"({k}::bigint, timestamp '{T0 + dt.timedelta(minutes=m)}', {u}::bigint, 'view', 20.0::double, '{{\"k\": {d // 4}}}')" for k, (u, m, d) in enumerate(rows))
    return f"select * from (values {values}) t(event_id, ts, user_id, event_type, value, props)"


def test_directions_at_north(spark, tmp_path):
    """Halfway between winds that are opposite but for a rounding error, and north of them."""
    rows = [(1, 0, 0), (1, 90, 272), (1, 1110, 88), (2, 0, 0), (2, 120, 80), (2, 780, 280), (3, 0, 0), (3, 60, 84), (3, 240, 276)]
    assert agrees(spark, tmp_path, "circular_direction", events=events(*rows)) == 24 + 17 + 6


PART = "select k::bigint as p_partkey, (k % 50 + 1)::integer as p_size, 900.0 + k % 1000 / 10 as p_retailprice from (select unnest(range({})) as k)"
CUSTOMER = "select unnest(range({}))::bigint as c_custkey"


def test_labels_of_many_users(spark, tmp_path):
    """Users of five digits of whom several have one label; 1000 has a place and 1500 has none."""
    users = [(u, 0, 0) for u in (1, 2, 333, 334, 3333, 3334, 3335, 3336, 3337, 3338, 5000, 5002)]
    assert agrees(spark, tmp_path, "terrain_by_position", events=events(*users), customer=CUSTOMER.format(1100), part=PART.format(2000)) == 38


#: Keys of seven digits, and those of six digits that they fall on when they lose the last one.
COLLIDING = "select k::bigint as p_partkey, (k * 7 % 50 + 1)::integer as p_size, 900.0 + k % 1000 / 10.0::double as p_retailprice from (select unnest(range(100000, 100040)) as k union all select unnest(range(1000000, 1000400)))"


@pytest.mark.parametrize("name", ["promotion_decisions", "promoted_heads", "model_load_status", "rejected_attempts"])
def test_colliding_keys(spark, tmp_path, name):
    assert agrees(spark, tmp_path, name, part=COLLIDING) > 5
