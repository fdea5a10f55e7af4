"""Weather, truth, coordinates, terrain and inclination out of the given tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SNAP = {
    "spark": "timestampadd(MINUTE, -cast(minute(ts) % 30 as int), cast(date_trunc('minute', ts) as timestamp_ntz))",
    "duckdb": "(date_trunc('minute', ts) - to_minutes(cast(minute(ts) % 30 as bigint)))",
}
_LATE = {
    "spark": f"timestampadd(MINUTE, -cast(event_id % 41 as int), {_SNAP['spark']})",
    "duckdb": f"({_SNAP['duckdb']} - to_minutes(cast(event_id % 41 as bigint)))",
}
_K = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duckdb": "cast(json_extract_string(props, '$.k') as bigint)"}


def _d(x: object) -> str:
    return f"cast({x} as double)"


def sql(name: str, dialect: str) -> str:
    """The view's SQL."""
    snap, late, k = _SNAP[dialect], _LATE[dialect], _K[dialect]
    tower = "lpad(cast(user_id as varchar(20)), 4, '0') as tower_id, 'line-' || cast(user_id % 5 as varchar(5)) as line_id"
    return {
        "weather_raw": f"""select event_id as row_order, {tower}, {snap} as timestamp,
            {_d(-5)} + {_d('(event_id * 37) % 450')} / {_d(10)} as ambient_temp, value / {_d(5)} as wind_speed, {_d(f'{k} * 4')} as wind_direction,
            case when event_type = 'error' then null else {_d('(event_id * 13) % 900')} end as solar_radiation,
            case when event_type = 'signup' then null else {_d('(event_id * 7) % 101')} end as humidity,
            {_d('800 + (user_id % 40) * 10')} as elevation, {_d(10)} as measurement_height,
            'physical' as dataset_role, 'P-' || event_type as source_file_hash from events""",
        "truth_raw": f"""select event_id as row_order, {tower}, {late} as timestamp,
            {_d(-5)} + {_d('(event_id * 37) % 450')} / {_d(10)} + {_d('(event_id % 7) - 3')} / {_d(2)} as ambient_temp,
            value * {_d(0.18)} + {_d('event_id % 5')} / {_d(5)} as wind_speed, {_d(f'({k} * 4 + 8) % 360')} as wind_direction,
            {_d('2 + (user_id % 3) * 4')} as measurement_height, 'truth' as dataset_role, 'T-' || event_type as source_file_hash
            from events where event_id % 5 <> 0""",
        "tower_coords_raw": f"""select 'T-' || lpad(cast(c_custkey as varchar(20)), 4, '0') as label,
            {_d(100)} + ({_d('c_custkey % 50')} + {_d(0.5)}) / {_d(100)} as lon, {_d(40)} - ({_d('floor(c_custkey / 50)')} + {_d(0.5)}) / {_d(100)} as lat from customer""",
        "dem_cells": f"""select cast(floor(p_partkey / 50) as bigint) as row, p_partkey % 50 as col, {_d('900 + p_size * 2')} as elevation, p_size % 17 = 0 as masked from part""",
        "inclination_raw": f"""select event_id as sample_order, {tower}, {snap} as timestamp,
            case when {k} >= 97 then {_d(0)} else {_d(6)} + {_d(f'{k} % 40')} / {_d(2)} end as angle_deg from events where event_type in ('click', 'view')""",
    }[name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = {"tower_coords_raw": "customer", "dem_cells": "part"}.get(name, "events")
    text = sql(name, "spark")
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.replace(f"from {table}", "from {source}"), source=source)
