"""Segments, lags, calendar cycles, and the data of residual models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.config import TIME_ZONE
from spanwatt.functions.parsing import micros

GROUP = ("line_id", "tower_id", "source_file_hash", "dataset_role")
DERIVED = ("lag_1", "hour_sin", "hour_cos", "day_sin", "day_cos", "direction_sin", "direction_cos", "solar_radiation", "humidity", "elevation", "slope", "aspect")
#: A value that the models keep for a missing one; no feature may equal it as a float.
SENTINEL = -1e30


def segments(df: DataFrame, minutes: int = 30, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Adds segment, numbered from 0 in each group: a step other than the cadence, exactly,
    begins a new one."""
    window = Window.partitionBy(*by).orderBy("timestamp")
    step = micros(F.col("timestamp")) - F.lag(micros(F.col("timestamp"))).over(window)
    return df.withColumn("_new", F.when(step != minutes * 60_000_000, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lag_1(df: DataFrame, value: str, by: tuple[str, ...] = GROUP) -> DataFrame:
    """The value before in the segment, the row's own at its start."""
    window = Window.partitionBy(*by, "segment").orderBy("timestamp")
    return df.withColumn("lag_1", F.coalesce(F.lag(value).over(window), F.col(value)))


def _optional(df: DataFrame, names: tuple[str, ...], default: float) -> Column:
    for c in names:
        if c in df.columns:
            return F.coalesce(F.col(c), F.lit(default))
    return F.lit(default)


def features(df: DataFrame, value: str, minutes: int = 30, by: tuple[str, ...] = GROUP) -> DataFrame:
    """The physical value and the derived columns of the models, in the time of the project's zone."""
    df = lag_1(segments(df, minutes, by), value, by)
    local = F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), TIME_ZONE)
    hour = (F.hour(local) + F.minute(local) / 60.0 + F.second(local) / 3600.0) / 24.0
    day = (F.dayofyear(local) - 1) / 365.25
    turn = F.radians(_optional(df, ("wind_direction",), 0.0))
    made = {
        "hour_sin": F.sin(2 * F.pi() * hour), "hour_cos": F.cos(2 * F.pi() * hour), "day_sin": F.sin(2 * F.pi() * day), "day_cos": F.cos(2 * F.pi() * day),
        "direction_sin": F.sin(turn), "direction_cos": F.cos(turn), "solar_radiation": _optional(df, ("solar_radiation_local", "solar_radiation"), 0.0),
        "humidity": _optional(df, ("humidity",), 50.0), "elevation": _optional(df, ("elevation",), 0.0), "slope": _optional(df, ("slope",), 0.0),
        "aspect": F.pmod(_optional(df, ("aspect",), 0.0), F.lit(360.0)),
    }
    df = df.withColumns(made)
    values = [F.col(value), *[F.col(c) for c in DERIVED]]
    collision, finite = F.lit(False), F.lit(True)
    for v in values:
        collision |= v.cast("float") == F.lit(SENTINEL).cast("float")
        finite &= F.coalesce(F.abs(v) < 1e300, F.lit(False))
    return df.withColumns({"sentinel_collision": F.coalesce(collision, F.lit(False)), "features_finite": finite})


TARGETS = {"wind_speed": ("wind_speed_local", "wind_speed_truth"), "ambient_temp": ("ambient_temp_local", "ambient_temp_truth")}


def residuals(aligned: DataFrame) -> DataFrame:
    """A row for each target of each matched row with both values finite: target, physical,
    truth, residual (truth minus corrected physical)."""
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), F.col(a).alias("physical"), F.col(b).alias("truth")) for k, (a, b) in TARGETS.items()])).alias("x")
    df = aligned.where("matched").select(*[c for c in aligned.columns if c not in ("target", "physical", "truth")], long).select("*", "x.target", "x.physical", "x.truth").drop("x")
    return df.where("abs(physical) < 1e300 and abs(truth) < 1e300").withColumn("residual", F.col("truth") - F.col("physical"))


KEYS = ("line_id", "tower_id", "target")


def holdout(df: DataFrame, keys: tuple[str, ...] = KEYS, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Adds split: the segment that starts last is holdout, rows of others before its start are
    train, other rows unused; with one segment, or no train row, all rows are full_fit."""
    start = df.withColumn("_start", F.min("timestamp").over(Window.partitionBy(*dict.fromkeys((*keys, *by)), "segment")))
    tag = F.struct("_start", *[c for c in by if c not in keys], "segment")
    all_ = Window.partitionBy(*keys)
    held = start.withColumn("_last", F.max(tag).over(all_))
    train = (tag != F.col("_last")) & (F.col("timestamp") < F.col("_last._start"))
    split = F.when(F.count_if(train).over(all_) == 0, "full_fit").when(tag == F.col("_last"), "holdout").when(train, "train").otherwise("unused")
    return held.withColumn("split", split).drop("_start", "_last")


def residual_bounds(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Robust bounds per key: 1 % and 99 % quantiles, drawn in to five scaled deviations around
    the median; crossed bounds are the median.  Groups are a tower's rows, quantiles exact."""
    q = df.groupBy(*keys).agg(F.percentile("residual", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q"), F.count("*").alias("rows"))
    mad = df.join(q.select(*keys, F.col("q")[1].alias("median")), list(keys)).groupBy(*keys).agg(F.percentile(F.abs(F.col("residual") - F.col("median")), 0.5).alias("mad"))
    both = q.join(mad, list(keys)).select(*keys, "rows", F.col("q")[0].alias("q01"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q99"), "mad")
    reach = 5.0 * 1.4826 * F.col("mad")
    low = F.when(F.col("mad") > 0, F.greatest(F.col("q01"), F.col("median") - reach)).otherwise(F.col("q01"))
    high = F.when(F.col("mad") > 0, F.least(F.col("q99"), F.col("median") + reach)).otherwise(F.col("q99"))
    return both.select(*keys, "rows", "median", "mad", F.when(low <= high, low).otherwise(F.col("median")).alias("lower"), F.when(low <= high, high).otherwise(F.col("median")).alias("upper"))
