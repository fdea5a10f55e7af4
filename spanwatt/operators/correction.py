"""The local weather correction: height, terrain, desert ground, angle of the wind; row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwatt.config import BOUNDS, Correction

from .guards import Rules, finite, required
from .quality import require_uncorrected


def input_rules() -> Rules:
    """What wind, temperature, radiation and direction must not be: missing, not finite or out of bounds."""
    rules = {}
    for c in ("wind_speed", "ambient_temp", "solar_radiation", "wind_direction"):
        low, high = BOUNDS.get(c, (0.0 if c == "solar_radiation" else -math.inf, math.inf))
        rules |= {f"{c}_not_finite": ~finite(F.col(c)), f"{c}_out_of_bounds": finite(F.col(c)) & ~F.col(c).between(low, high)}
    return rules


def terrain_factor(direction: Column, slope: Column, aspect: Column) -> Column:
    """Up to 30 % more wind on the windward side of a slope, less on the lee side."""
    impact = F.cos(F.radians(F.pmod(direction, F.lit(360.0)) - F.pmod(aspect, F.lit(360.0))))
    strength = F.least(slope / 45.0 * 0.4, F.lit(0.3))
    return F.when(slope < 2.0, 1.0).when(impact < -0.5, 1.0 + strength).when(impact > 0.5, 1.0 - strength).otherwise(1.0)


def desert_solar(solar: Column, temperature: Column, o: Correction) -> Column:
    albedo, offset = min(max(o.ground_albedo, 0.0), 1.0), min(max(o.ground_temp_offset, 0.0), 100.0)
    air = F.least(F.greatest(temperature, F.lit(-100.0)), F.lit(100.0)) + 273.15
    extra = 5.67e-8 * (F.pow(air + offset, F.lit(4.0)) - F.pow(air, F.lit(4.0))) * 0.15
    return F.greatest(solar * (1.0 + albedo * 0.3) + extra, F.lit(0.0))


def wind_angle(direction: Column, o: Correction) -> Column:
    """0..90 degrees between wind and line; without wind directions the wind is square to it."""
    if not o.direction:
        return F.lit(90.0)
    gap = F.abs(F.pmod(F.pmod(direction, F.lit(360.0)) - o.line_azimuth_deg % 360.0, F.lit(360.0)))
    return F.least(gap, 360.0 - gap, F.abs(180.0 - gap))


def correct(df: DataFrame, o: Correction = Correction(), checked: bool = False) -> DataFrame:
    """Corrects once; weather that was corrected before is refused.  Physical values stay in
    columns *_physical, results go to *_local, and the factors are kept.

    checked: fail on a row that breaks ``input_rules``; ``guards.divided`` keeps such rows apart instead.
    """
    df = require_uncorrected(df)
    if checked:
        df = required(df, input_rules(), "the weather can't be corrected")
    for c in ("slope", "aspect"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    vertical, lapse = 1.0, 0.0
    if o.vertical and o.ref_height_m > 0 and o.line_height_m > 0:
        vertical = min(o.line_height_m / max(o.ref_height_m, 1.0), 1000.0) ** min(max(o.roughness_alpha, 0.0), 1.0)
        lapse = min(max(o.temp_lapse_rate * (o.line_height_m - o.ref_height_m), -100.0), 100.0)
    factor = terrain_factor(F.col("wind_direction"), F.col("slope"), F.col("aspect")) if o.terrain else F.lit(1.0)
    df = df.withColumns({"vertical_wind_factor": F.lit(vertical), "terrain_wind_factor": factor, "ambient_temp_local": F.col("ambient_temp") - lapse, "wind_angle_deg": wind_angle(F.col("wind_direction"), o)})
    solar = desert_solar(F.col("solar_radiation"), F.col("ambient_temp_local"), o) if o.desert else F.col("solar_radiation")
    df = df.withColumns({"wind_speed_local": F.col("wind_speed") * vertical * F.col("terrain_wind_factor"), "solar_radiation_local": solar, **{f"{c}_physical": F.col(c) for c in ("wind_speed", "ambient_temp", "solar_radiation")}})
    return df.withColumns({
        "wind_speed_raw": F.col("wind_speed_physical"), "ambient_temp_raw": F.col("ambient_temp_physical"), "wind_speed_corrected": F.col("wind_speed_local"),
        "ambient_temp_corrected": F.col("ambient_temp_local"), "wind_angle_factor": F.lit(1.0), "correction_stage": F.lit("terrain_corrected"),
    })


def effect(corrected: DataFrame) -> DataFrame:
    """Per tower: mean wind before and after, the change in percent, mean factors."""
    before, after = F.avg("wind_speed_physical"), F.avg("wind_speed_local")
    return corrected.groupBy("tower_id").agg(
        before.alias("wind_before"), after.alias("wind_after"), F.when(before > 0, (after - before) / before * 100.0).otherwise(0.0).alias("change_percent"),
        F.avg("vertical_wind_factor").alias("vertical_factor"), F.avg("terrain_wind_factor").alias("terrain_factor"), F.avg("wind_angle_factor").alias("direction_factor"),
    )


def solar_effect(corrected: DataFrame) -> DataFrame:
    before, after = F.avg("solar_radiation_physical"), F.avg("solar_radiation_local")
    return corrected.groupBy("tower_id").agg(before.alias("solar_before"), after.alias("solar_after"), (after - before).alias("solar_delta"))


def combined_factor(corrected: DataFrame) -> DataFrame:
    return corrected.select("tower_id", "timestamp", (F.col("vertical_wind_factor") * F.col("terrain_wind_factor") * F.col("wind_angle_factor")).alias("combined_factor"))
