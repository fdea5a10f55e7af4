"""Regular time grids: per tower, and common to all towers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.functions.parsing import from_micros, micros

LINEAR = ("ambient_temp", "wind_speed", "solar_radiation", "humidity", "elevation")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that are interpolated in time: the measures, and places and heights."""
    marks = ("longitude", "latitude", "elevation", "altitude", "height")
    kinds = dict(df.dtypes)
    return [c for c in df.columns if kinds[c] in ("double", "float", "int", "bigint") and (c in LINEAR or any(m in c for m in marks))]


def _between(t: Column, before: Column, after: Column) -> Column:
    """Linear in time between two (t, v) structs; at a reading itself, the reading.  The product comes before the
    quotient, as in the SQL: a direction within a rounding error of north falls on the side that this order gives."""
    return F.when(t == before["t"], before["v"]).otherwise(before["v"] + (after["v"] - before["v"]) * (t - before["t"]) / (after["t"] - before["t"]))


def resample(df: DataFrame, minutes: int, direction: str = "wind_direction", by: tuple[str, ...] = ("tower_id",)) -> DataFrame:
    """Every tower on a grid from its first reading on, and at its exact last reading.

    Values are linear in time between the nearest readings that have one, with no
    extrapolation; the wind direction is interpolated on the circle; other columns take the
    last value before, else the next one.  Rows must be unique by tower and time.  One exchange
    by tower; every reading emits the grid points up to the next reading, so nothing is
    collected.  A following value comes from a descending window, whose cost is linear.
    """
    step = minutes * 60_000_000
    back = Window.partitionBy(*by).orderBy("t")
    ahead = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    linear = numeric_columns(df)
    angle = F.radians(direction)
    parts = {c: F.col(c).cast("double") for c in linear} | {"_sin": F.sin(angle), "_cos": F.cos(angle)}
    others = [c for c in df.columns if c not in (*linear, direction, "timestamp", *by)]
    df = df.withColumns({"t": micros(F.col("timestamp")), **{k: v for k, v in parts.items() if k[0] == "_"}})
    pair = {c: F.when(v.isNotNull() if c[0] != "_" else F.col(c).isNotNull(), F.struct("t", (v if c[0] != "_" else F.col(c)).alias("v"))) for c, v in parts.items()}
    df = df.withColumns({f"{c}_a": F.last(p, True).over(upto) for c, p in pair.items()} | {f"{c}_a": F.last(c, True).over(upto) for c in others} | {"t0": F.min("t").over(Window.partitionBy(*by)), "next": F.lead("t").over(back)})
    df = df.withColumns({f"{c}_b": F.last(p, True).over(ahead) for c, p in pair.items()} | {f"{c}_b": F.last(c, True).over(ahead) for c in others})
    since = F.col("t") - F.col("t0")
    first = (since + step - 1 - F.pmod(since + step - 1, F.lit(step))).cast("long")
    end = F.coalesce(F.col("next") - F.col("t0") - 1, since)
    grid = F.when(first <= end, F.sequence(first, end, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    # the exact end of a tower that the grid doesn't meet
    grid = F.when(F.col("next").isNull() & (F.pmod(since, F.lit(step)) != 0), F.array(since)).otherwise(grid)
    df = df.withColumn("g", F.explode(grid)).withColumn("g", F.col("g") + F.col("t0"))
    values = {c: _between(F.col("g"), F.col(f"{c}_a"), F.col(f"{c}_b")) for c in parts}
    out = df.select(*by, from_micros(F.col("g")).alias("timestamp"), *[v.alias(c) for c, v in values.items()], *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in others])
    s, c = F.col("_sin"), F.col("_cos")
    turned = F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))
    return out.withColumn(direction, F.when(F.sqrt(s * s + c * c) > 1e-12, F.when(turned >= 360.0, 0.0).otherwise(turned))).drop("_sin", "_cos")


def source_hashes(df: DataFrame, by: tuple[str, ...] = ("dataset_role",)) -> DataFrame:
    """The sorted set of file hashes that a grid row may blend."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set("source_file_hash")).alias("source_hashes"))


def common_axis(df: DataFrame, minutes: int, count: int | None = None) -> DataFrame:
    """All towers on one axis from the first to the last time of the whole set, in ``count``
    equal steps (default: whole intervals in the span, plus one).

    Values are linear in time and held at a tower's ends, the direction is linear and then
    taken modulo 360; temperature, wind and radiation are clipped; elevation is the tower's
    mean and radiation the mean over towers at that time.  The axis is a few thousand times and
    is broadcast; readings and axis points of a tower meet by a union and windows.
    """
    readings = df.withColumn("t", micros(F.col("timestamp")).cast("double"))
    ends = readings.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    n = F.lit(count) if count else (F.floor((F.col("t1") - F.col("t0")) / (minutes * 60e6)) + 1).cast("int")
    axis = ends.select("t0", "t1", n.alias("n")).select("t0", "t1", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("step"))
    axis = axis.select("step", (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("step") / F.greatest(F.col("n") - 1, F.lit(1))).alias("t"))
    towers = df.groupBy("tower_id").agg(F.avg("elevation").alias("elevation"))
    values = ("ambient_temp", "wind_speed", "solar_radiation", "wind_direction")
    points = towers.select("tower_id").crossJoin(F.broadcast(axis))
    both = readings.select("tower_id", "t", F.lit(None).cast("int").alias("step"), *values).unionByName(points, allowMissingColumns=True)
    # at an equal time the reading comes first
    order = ["t", F.col("step").asc_nulls_first()]
    upto = Window.partitionBy("tower_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("tower_id").orderBy(F.col("t").desc(), F.col("step").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    reading = F.when(F.col("step").isNull(), F.struct("t", *values))
    both = both.withColumns({"a": F.last(reading, True).over(upto), "b": F.last(reading, True).over(down)}).where("step is not null")

    def at(c: str) -> Column:
        share = (F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
        inside = F.when(F.col("a.t") == F.col("b.t"), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share)
        return F.coalesce(inside, F.col(f"a.{c}"), F.col(f"b.{c}"))

    def clip(c: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(c, F.lit(low)), F.lit(high))

    made = both.select("tower_id", "step", "t", clip(at("ambient_temp"), -50.0, 70.0).alias("ambient_temp"), clip(at("wind_speed"), 0.1, 20.0).alias("wind_speed"), F.pmod(at("wind_direction"), F.lit(360.0)).alias("wind_direction"), clip(at("solar_radiation"), 0.0, 1500.0).alias("solar"))
    solar = made.groupBy("step").agg(F.avg("solar").alias("solar_radiation"))
    return made.drop("solar").join(solar, "step").join(towers, "tower_id")
