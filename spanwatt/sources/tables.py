"""Coordinates, inclination readings and results as files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwatt.functions.parsing import instant, number, tower_id

from .weather import Layout, clean_header, read_rows, usable

# Header marks of the tables.
PLACE_HEADERS = {"label": ("运行编号", "设备名称"), "lon": ("经度", "X坐标"), "lat": ("纬度", "Y坐标")}
INCLINATION = Layout("inclination", (("angle_deg", ("angle_deg", "inclination_angle", "inclination", "倾角")), ("tower_id", ("tower_id", "tower", "杆塔")), ("timestamp", ("timestamp", "time", "时间"))), ("angle_deg",))
HEADER_ROWS = 20


def _pick(columns: list[str], marks: tuple[str, ...]) -> str | None:
    return next((c for m in marks for c in columns if m in c), None)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """label, lon, lat of a table whose header row is among the first 20 rows."""
    raw = spark.read.csv(path)
    head = raw.limit(HEADER_ROWS).collect()
    for row in head:
        cells = [clean_header(c or "") for c in row]
        found = {k: _pick(cells, m) for k, m in PLACE_HEADERS.items()}
        if all(found.values()):
            at = {k: raw.columns[cells.index(v)] for k, v in found.items()}
            return raw.select(F.col(at["label"]).alias("label"), number(F.col(at["lon"])).alias("lon"), number(F.col(at["lat"])).alias("lat")).where("lon is not null and lat is not null")
    raise ValueError("no header row with name, longitude and latitude")


def read_inclination(spark: SparkSession, paths: list[str], tower: str | None = None, axis: DataFrame | None = None) -> DataFrame:
    """tower_id, timestamp, sample_index, angle_deg, timestamp_source.

    Without a time column the times are the snapshot's, if it has as many rows (axis: one
    column timestamp), else only the index counts.
    """
    kind = INCLINATION if tower is not None else replace(INCLINATION, must=("tower_id",))
    files = usable(spark, paths, (kind,))
    order = spark.createDataFrame([(r.path, k) for k, r in enumerate(files)], "path string, _f long")
    rows = read_rows(spark, paths, (kind,), files).join(order, "path")
    who = F.when(F.array_contains("has", "tower_id"), tower_id(F.col("tower_id"))).otherwise(F.lit(tower))
    df = rows.select(who.alias("tower_id"), instant(F.col("timestamp")).alias("timestamp"), number(F.col("angle_deg")).alias("angle_deg"), F.struct("_f", "row_order").alias("_o"))
    df = df.withColumn("sample_index", (F.row_number().over(Window.partitionBy("tower_id").orderBy("_o")) - 1).cast("long")).drop("_o")
    df = df.withColumn("timestamp_source", F.when(F.col("timestamp").isNotNull(), "measured").otherwise("sequence"))
    if axis is not None:
        numbered = axis.select("timestamp").distinct().withColumn("sample_index", (F.row_number().over(Window.orderBy("timestamp")) - 1).cast("long")).withColumnRenamed("timestamp", "_t")
        sizes = df.groupBy("tower_id").agg(F.count("*").alias("_n")).crossJoin(numbered.agg(F.count("*").alias("_m")))
        df = df.join(numbered, "sample_index", "left").join(sizes, "tower_id")
        take = F.col("timestamp").isNull() & (F.col("_n") == F.col("_m"))
        df = df.withColumns({"timestamp": F.when(take, F.col("_t")).otherwise(F.col("timestamp")), "timestamp_source": F.when(take, "snapshot").otherwise(F.col("timestamp_source"))}).drop("_t", "_n", "_m")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose header begins with a byte-order mark, for spreadsheets."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON documents, a folder for each result."""
    df.write.partitionBy("result_id").mode("append").json(path)
