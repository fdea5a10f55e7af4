"""Files written from the given tables and read again: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwatt.sources import weather
from spanwatt.storage import shared_dir

from .views import sql, view
from .weather import r6

MEASURES = ("ambient_temp", "wind_speed", "wind_direction", "solar_radiation", "humidity", "elevation")


def weather_files(spark: SparkSession, sf: str) -> str:
    """A folder of CSV files, one for each kind of event and layout, whose names are the same in many folders.

    Odd towers have the layout of towers and times, even ones that of positions and clocks.  Some winds are no number and some
    longitudes are missing.
    """
    k, tower = F.col("row_order"), F.col("tower_id").cast("long")
    text = lambda c: F.col(c).cast("string")
    raw = view(spark, sf, "weather_raw").withColumns({
        "wind": F.when(k % 97 == 0, "calm").otherwise(text("wind_speed")), "lon": F.when(k % 61 != 0, (F.lit(100.0) + tower % 50 / 100.0).cast("string")), "lat": (F.lit(40.0) - tower % 30 / 100.0).cast("string"),
        "file": F.concat(F.substring_index("source_file_hash", "-", -1), F.when(tower % 2 == 1, "-towers").otherwise("-positions")),
    })
    towers = {"时间": F.date_format("timestamp", "yyyy-MM-dd HH:mm"), "杆塔": F.concat("tower_id", F.lit("号")), "经度": F.col("lon"), "纬度": F.col("lat"), "风速WS(m/s)": F.col("wind"), "风向WD(°)": text("wind_direction"), "温度TEM(℃)": text("ambient_temp"), "相对湿度RHU(%)": text("humidity")}
    positions = {"位置": tower.cast("string"), "日期": F.date_format("timestamp", "yyyy-MM-dd"), "时刻": F.date_format("timestamp", "HH:mm"), "环境温度": text("ambient_temp"), "风速": F.col("wind"), "风向": text("wind_direction"), "太阳辐射强度": text("solar_radiation"), "相对湿度": text("humidity"), "海拔": text("elevation")}
    folder = shared_dir(spark)
    for odd, columns in ((1, towers), (0, positions)):
        rows = raw.where(tower % 2 == odd).select("file", "row_order", *[c.alias(name) for name, c in columns.items()])
        rows.repartition("file").sortWithinPartitions("file", "row_order").drop("row_order").write.mode("append").partitionBy("file").option("header", True).csv(folder)
    return folder


def ingested_weather(spark: SparkSession, sf: str) -> DataFrame:
    """All files in one reading; a fixture written from events."""
    made, _ = weather.ingest(spark, [weather_files(spark, sf)], "physical")
    return made.select(F.regexp_extract("path", "file=([^/]+)", 1).alias("file"), "row_order", "tower_id", "timestamp", *[r6(c).alias(c) for c in (*MEASURES, "longitude", "latitude")])


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report over all files of the fixture, and how many files there are, by their bytes."""
    _, report = weather.ingest(spark, [weather_files(spark, sf)], "physical")
    return report.groupBy("reason").agg(F.sum(F.when(F.col("source_file_hash").isNull(), F.col("rows"))).alias("rows"), F.countDistinct("source_file_hash").alias("files"))


def inspected_files(spark: SparkSession, sf: str) -> DataFrame:
    made = weather.inspect(spark, [weather_files(spark, sf)])
    return made.groupBy("encoding", "layout", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("files"))


QUERIES = {f.__name__: f for f in (ingested_weather, ingest_report, inspected_files)}

_ROWS = f"""raw as (select *, tower_id::bigint as t from ({sql("weather_raw", "duckdb")})),
filed as (
    select split_part(source_file_hash, '-', 2) || case when t % 2 = 1 then '-towers' else '-positions' end as file, row_order as k, t % 2 = 1 as odd, case when t % 2 = 1 then tower_id else t::varchar end as tower_id, timestamp - interval 8 hour as timestamp, ambient_temp,
        case when row_order % 97 <> 0 then wind_speed end as wind_speed, case when wind_direction = 360 then 0 else wind_direction end as wind_direction, wind_direction > 360 as turned, case when t % 2 = 1 then 0 else coalesce(solar_radiation, 0) end as solar_radiation, coalesce(humidity, 50) as humidity,
        case when t % 2 = 1 then 1000 else elevation end as elevation, case when t % 2 = 1 and row_order % 61 <> 0 then 100 + t % 50 / 100.0::double end as longitude, case when t % 2 = 1 then 40 - t % 30 / 100.0::double end as latitude from raw
),
judged as (
    select *, row_number() over (partition by file order by k) - 1 as row_order, list_filter([case when wind_speed is null then 'missing_wind_speed' end, case when wind_speed not between 0 and 75 then 'wind_speed_out_of_range' end, case when turned then 'wind_direction_out_of_range' end,
        case when odd and longitude is null then 'longitude_not_finite' end], lambda x: x is not null) as reasons from filed
),
firsts as (select *, case when len(reasons) = 0 then row_number() over (partition by tower_id, timestamp, len(reasons) = 0 order by file, row_order) end as n from judged)"""
_r = lambda c: f"round({c} + 1e-9, 6) + 0.0::double as {c}"

SQL = {
    "ingested_weather": f"with {_ROWS} select file, row_order, tower_id, timestamp, {', '.join(_r(c) for c in (*MEASURES, 'longitude', 'latitude'))} from firsts where n = 1",
    "ingest_report": f"""with {_ROWS}, codes as (
            select file, unnest(list_concat(reasons, ['input_rows'], case when n > 1 then ['duplicate_tower_timestamp'] else [] end, case when n = 1 then ['valid_rows'] else ['dropped_rows'] end)) as reason from firsts
        ) select reason, count(*)::bigint as rows, count(distinct file) as files from codes group by 1""",
    "inspected_files": f"with {_ROWS} select 'utf-8-sig' as encoding, case when odd then 'tower' else 'legacy' end as layout, 'none' as problem, count(distinct file) as files from filed group by 2",
}
