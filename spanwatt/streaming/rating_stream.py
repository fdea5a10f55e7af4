"""Weather as it arrives: the row-wise part of the ratings job runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatt.config import Conductor, Correction
from spanwatt.functions import physics
from spanwatt.operators import correction, quality
from spanwatt.operators.ratings import publish


def rate_stream(weather: DataFrame, conductor: Conductor, options: Correction = Correction(), late: str = "2 hours") -> DataFrame:
    """Valid readings with their ratings, each tower and time once while it is not later than
    ``late``.  Every row is rated at its own elevation."""
    good = quality.validated(weather).where(F.size("reasons") == 0).drop("reasons").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    once = good.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["tower_id", "timestamp"])
    df = correction.correct(once, options)
    parts = physics.heat_balance(conductor, F.lit(conductor.max_temp), F.col("ambient_temp_local"), F.col("wind_speed_local"), F.col("wind_angle_deg"), F.col("elevation"), F.col("solar_radiation_local"))
    return publish(df.withColumn("raw_rating_a", parts["current_a"]))


def line_minimum(rated: DataFrame, window: str = "30 minutes") -> DataFrame:
    """The lowest rating of each line in windows of event time; final once the watermark has passed."""
    return rated.groupBy(F.window("timestamp", window), "line_id").agg(F.min(F.struct("rating_a", "tower_id")).alias("w")).select("line_id", F.col("window.start").alias("start"), F.col("w.rating_a").alias("line_rating_a"), F.col("w.tower_id").alias("bottleneck_tower"))
