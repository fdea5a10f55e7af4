"""Steady ratings of towers and lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.config import SAFETY_FACTOR, Conductor
from spanwatt.functions import physics

from .guards import Rules, finite, required


def common_times(df: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """Rows at times that every tower of the line has; towers and times must be unique.

    Counts per line and time are aggregated before they move; a line without such a time has
    no rows.  readings: a smaller table with the same towers, to count these on."""
    towers = (df if readings is None else readings).groupBy("line_id").agg(F.countDistinct("tower_id").alias("towers"))
    full = df.groupBy("line_id", "timestamp").agg(F.count("*").alias("n")).join(towers, "line_id").where("n = towers").select("line_id", "timestamp")
    return df.join(full, ["line_id", "timestamp"], "left_semi")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def input_rules(conductor: Conductor) -> Rules:
    """What the inputs of a steady rating must not be: missing, not finite, under absolute zero, above the highest
    allowed temperature, or a negative wind or radiation."""
    c = {x: F.col(x).cast("double") for x in ("ambient_temp_local", "wind_speed_local", "wind_angle_deg", "solar_radiation_local", "elevation")}
    rules = {f"{x}_not_finite": ~finite(v) for x, v in c.items()}
    return rules | {
        "below_absolute_zero": c["ambient_temp_local"] <= -273.15, "above_max_temp": c["ambient_temp_local"] > conductor.max_temp,
        "negative_wind": c["wind_speed_local"] < 0.0, "negative_solar": c["solar_radiation_local"] < 0.0,
    }


def checked_conductor(conductor: Conductor) -> Conductor:
    """The conductor, if its scalars can be rated."""
    for name in ("diameter", "r25", "r75", "r200"):
        value = getattr(conductor, name)
        if not (math.isfinite(value) and value > 0):
            raise ValueError(f"{name} must be positive: {value}")
    for name in ("emissivity", "absorptivity"):
        value = getattr(conductor, name)
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be from 0 to 1: {value}")
    if not (math.isfinite(conductor.max_temp) and conductor.max_temp > -273.15):
        raise ValueError(f"max_temp must be above absolute zero: {conductor.max_temp}")
    return conductor


def first_elevation(df: DataFrame) -> DataFrame:
    """A tower is rated at the elevation of its first row."""
    by_tower = Window.partitionBy("tower_id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("rated_elevation", F.first("elevation").over(by_tower))


def rate_steady(corrected: DataFrame, conductor: Conductor, surface: float | None = None, checked: bool = False) -> DataFrame:
    """Adds rated_elevation, unless the rows are a part of a series and bring it; raw_rating_a, the current that holds the highest allowed temperature, and
    rating_a, which is published: the safety factor applies once, to finite ratings only.

    checked: fail on a row that breaks ``input_rules``; ``guards.divided`` keeps such rows apart instead.
    """
    checked_conductor(conductor)
    if checked:
        corrected = required(corrected, input_rules(conductor), "the weather can't be rated")
    df = corrected if "rated_elevation" in corrected.columns else first_elevation(corrected)
    parts = physics.heat_balance(conductor, F.lit(surface or conductor.max_temp), F.col("ambient_temp_local"), F.col("wind_speed_local"), F.col("wind_angle_deg"), F.col("rated_elevation"), F.col("solar_radiation_local"))
    raw = parts["current_a"]
    return publish(df.withColumn("raw_rating_a", raw))


def publish(rated: DataFrame, column: str = "raw_rating_a") -> DataFrame:
    ok = (F.col(column) >= 0.0) & (F.col(column) < 1e300)
    return rated.withColumns({"rating_a": F.when(ok, F.col(column) * SAFETY_FACTOR), "safety_factor": F.lit(SAFETY_FACTOR)})


def bottleneck(rated: DataFrame) -> DataFrame:
    """Per line and time the lowest rating and its tower, the first id among equals."""
    worst = F.min(F.struct("rating_a", "tower_id"))
    return rated.groupBy("line_id", "timestamp").agg(worst.alias("w"), F.count("*").alias("towers")).select("line_id", "timestamp", F.col("w.rating_a").alias("line_rating_a"), F.col("w.tower_id").alias("bottleneck_tower"), "towers")


def line_summary(lines: DataFrame) -> DataFrame:
    r = "line_rating_a"
    return lines.groupBy("line_id").agg(F.count("*").alias("times"), F.min(r).alias("min_a"), F.max(r).alias("max_a"), F.avg(r).alias("mean_a"))


def tower_summary(corrected: DataFrame) -> DataFrame:
    by_time = lambda c: F.min_by(c, "timestamp")
    return corrected.groupBy("tower_id").agg(F.avg("wind_speed_local").alias("mean_wind"), F.max("ambient_temp_local").alias("max_temp"), by_time("elevation").alias("elevation"), by_time("slope").alias("slope"), by_time("aspect").alias("aspect"))


def daylight_hours(df: DataFrame, least: float = 10.0) -> DataFrame:
    """Per line the first and last clock hour at which the mean radiation over its towers
    exceeds ``least``; 6 and 18 where it never does."""
    lit_ = df.groupBy("line_id", "timestamp").agg(F.avg("solar_radiation").alias("s"))
    hour = F.when(F.col("s") > least, F.hour("timestamp") + F.minute("timestamp") / 60.0)
    return lit_.groupBy("line_id").agg(F.coalesce(F.min(hour), F.lit(6.0)).alias("first_hour"), F.coalesce(F.max(hour), F.lit(18.0)).alias("last_hour"))


def incomplete_towers(rated: DataFrame, value: str = "rating_a") -> DataFrame:
    """Towers that lack a value at some time of their line, with the number that they lack."""
    times = rated.groupBy("line_id").agg(F.countDistinct("timestamp").alias("times"))
    own = rated.groupBy("line_id", "tower_id").agg(F.count(F.when(F.abs(value) < 1e300, 1)).alias("have"))
    return own.join(times, "line_id").where("have < times").select("line_id", "tower_id", (F.col("times") - F.col("have")).alias("lacking"))
