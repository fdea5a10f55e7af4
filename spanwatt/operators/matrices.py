"""Towers by times as arrays over blocks of time: what exports and array programs ask for, at any length of axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.config import DEFAULTS, Correction
from spanwatt.functions.parsing import from_micros, micros

from .correction import correct
from .guards import finite

DAY = 24.0


def _block(hours: float) -> Column:
    """Where a row's block of time begins, in microseconds."""
    length = F.lit(int(hours * 3.6e9)).cast("long")
    t = micros(F.col("timestamp"))
    return t - F.pmod(t, length)


def blocks(df: DataFrame, values: list[str], hours: float = DAY, by: str = "line_id", complete: bool = True) -> DataFrame:
    """by, tower_id, block, times and an array for each of ``values``, in time order: a row for a tower and a block of
    ``hours``, so that no row grows with the axis.

    In a block every tower of the line must have each of the block's times once, with finite values.  Else the
    job fails (complete), or problem says why: duplicate, not_finite, missing_times or missing_towers (null: none).  A tower that
    lacks a block altogether shows as missing_towers in the others' rows.
    """
    rows = df.select(by, "tower_id", "timestamp", *values).withColumn("_b", _block(hours))
    sound = F.lit(True)
    for v in values:
        sound = sound & finite(F.col(v).cast("double"))
    cells = rows.groupBy(by, "_b", "tower_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", *values))).alias("_c"), F.count_if(sound).alias("_good"), F.countDistinct("timestamp").alias("_own"))
    axis = rows.groupBy(by, "_b").agg(F.countDistinct("timestamp").alias("_times"), F.countDistinct("tower_id").alias("_here"))
    towers = df.groupBy(by).agg(F.countDistinct("tower_id").alias("_towers"))
    made = cells.join(axis, [by, "_b"]).join(towers, by)
    n = F.size("_c")
    problem = F.when(n > F.col("_own"), "duplicate").when(F.col("_good") < n, "not_finite").when(F.col("_own") < F.col("_times"), "missing_times").when(F.col("_here") < F.col("_towers"), "missing_towers")
    made = made.withColumn("problem", problem)
    if complete:
        said = F.concat(F.lit("the matrix is not complete: "), "problem", F.lit(" at tower "), "tower_id")
        made = made.where(F.when(F.col("problem").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop("problem")
    return made.select(by, "tower_id", from_micros(F.col("_b")).alias("block"), F.col("_c.timestamp").alias("times"), *[F.col(f"_c.{v}").alias(v) for v in values], *([] if complete else ["problem"]))


FACTORS = ["wind_speed_local", "ambient_temp_local", "wind_angle_deg", "vertical_wind_factor", "terrain_wind_factor", "wind_angle_factor"]


def corrected_blocks(df: DataFrame, options: Correction = Correction(), hours: float = DAY, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """The correction of a line whose radiation is one value a time: (blocks with the corrected values and the factor grids,
    the axis with the mean radiation before and after).

    Radiation is averaged over the line's towers at each time, corrected with every tower's temperature, and averaged
    again.
    """
    mean = df.groupBy("line_id", "timestamp").agg(F.avg("solar_radiation").alias("_solar"))
    local = correct(df.join(mean, ["line_id", "timestamp"]).withColumn("solar_radiation", F.col("_solar")).drop("_solar"), options)
    axis = local.groupBy("line_id", "timestamp").agg(F.first("solar_radiation_physical").alias("solar_before"), F.avg("solar_radiation_local").alias("solar_after"))
    return blocks(local, FACTORS, hours, complete=complete), axis.withColumn("solar_delta", F.col("solar_after") - F.col("solar_before"))


def tower_arrays(df: DataFrame, hours: float = DAY) -> tuple[DataFrame, DataFrame]:
    """Readings as arrays in time order: (tower_id, block, hour, ambient_temp, wind_speed, wind_direction, humidity, elevation),
    and the axis (timestamp, hour, solar_radiation) with the mean radiation over the towers.

    Rows without tower, time, temperature, wind or direction are left out.  A missing elevation is the mean of all, humidity and
    radiation take their defaults, as do columns that are absent.  Hours count from the first time of all; readings within
    one day keep the hours of the clock.
    """
    rows = df.dropna(subset=["tower_id", "timestamp", "ambient_temp", "wind_speed", "wind_direction"])
    for c, default in DEFAULTS.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(default))
    whole = rows.agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"), F.coalesce(F.avg("elevation"), F.lit(DEFAULTS["elevation"])).alias("_mean"))  # one row
    rows = rows.crossJoin(F.broadcast(whole))
    since = (micros(F.col("timestamp")) - micros(F.col("_first"))) / 3.6e9
    one_day = micros(F.col("_last")) - micros(F.col("_first")) < 24 * 3_600_000_000
    hour = F.when(one_day, F.hour("timestamp") + F.minute("timestamp") / 60.0).otherwise(since)
    rows = rows.withColumns({"hour": hour, "elevation": F.coalesce("elevation", "_mean"), **{c: F.coalesce(c, F.lit(DEFAULTS[c])) for c in ("humidity", "solar_radiation")}}).drop("_first", "_last", "_mean")
    fields = ["hour", "ambient_temp", "wind_speed", "wind_direction", "humidity", "elevation"]
    cells = rows.withColumn("_b", _block(hours)).groupBy("tower_id", "_b").agg(F.array_sort(F.collect_list(F.struct("timestamp", *fields))).alias("_c"))
    axis = rows.groupBy("timestamp", "hour").agg(F.avg("solar_radiation").alias("solar_radiation"))
    return cells.select("tower_id", from_micros(F.col("_b")).alias("block"), *[F.col(f"_c.{f}").alias(f) for f in fields]), axis


def slice_of(table: DataFrame, tower_id: str, times: DataFrame) -> DataFrame:
    """A tower's rows of a table at the given times (one column timestamp), for a plot; in time order."""
    return table.where(F.col("tower_id") == tower_id).join(times.select("timestamp").distinct(), "timestamp", "left_semi").orderBy("timestamp")


def numbered_axis(df: DataFrame, by: str = "line_id") -> DataFrame:
    """by, timestamp, position: the place of each of a line's times in its axis."""
    return df.select(by, "timestamp").distinct().withColumn("position", (F.row_number().over(Window.partitionBy(by).orderBy("timestamp")) - 1).cast("long"))
