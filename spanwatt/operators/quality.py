"""Row validation, duplicates, reports and guards of weather tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.config import BOUNDS, DEFAULTS

from .guards import required

KEY = ["tower_id", "timestamp"]


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing solar radiation, humidity and elevation take their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def reasons(df: DataFrame) -> Column:
    """The array of reason codes of a row; a row may carry several.  A missing value is null,
    an infinite one is present but out of range."""

    def outside(c: str, low: float, high: float) -> Column:
        return F.when(~F.col(c).between(low, high), f"{c}_out_of_range")

    must = ("ambient_temp", "wind_speed", "wind_direction")
    tests = [F.when(F.col("tower_id").isNull(), "invalid_tower_id"), F.when(F.col("timestamp").isNull(), "invalid_timestamp")]
    tests += [F.when(F.col(c).isNull(), f"missing_{c}") for c in must]
    tests += [outside(c, *BOUNDS[c]) for c in ("wind_speed", "ambient_temp")]
    tests += [outside("wind_direction", 0.0, 360.0), outside("humidity", 0.0, 100.0), F.when(~F.col("solar_radiation").between(0.0, 1e300), "solar_radiation_out_of_range")]
    for c in ("elevation", "longitude", "latitude"):
        if c in df.columns:
            tests.append(F.when(F.col(c).isNull() | (F.abs(c) > 1e300), f"{c}_not_finite"))
    return F.array_compact(F.array(*tests))


def validated(df: DataFrame) -> DataFrame:
    """Adds reasons, and puts a wind direction of 360 to 0; leaves rows that have reasons alone."""
    if "reasons" in df.columns:
        return df
    df = with_defaults(df)
    return df.withColumn("reasons", reasons(df)).withColumn("wind_direction", F.when(F.col("wind_direction") == 360.0, 0.0).otherwise(F.col("wind_direction")))


def deduplicated(valid: DataFrame, order: list[str]) -> DataFrame:
    """Of rows that share tower and time the first in input order stays; marks it as ``first``.

    The window is partitioned by tower and ordered by time, as the resampling is, so that one
    exchange serves both.
    """
    by_tower = Window.partitionBy("tower_id").orderBy("timestamp", *order)
    return valid.withColumn("first", F.coalesce(F.lag("timestamp").over(by_tower) != F.col("timestamp"), F.lit(True)))


def clean_weather(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Valid rows, one per tower and time."""
    good = validated(df).where(F.size("reasons") == 0).drop("reasons")
    return deduplicated(good, order or ["row_order"]).where("first").drop("first")


def report(df: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """(group, reason, rows) with the totals input_rows, valid_rows, dropped_rows and
    duplicate_tower_timestamp; duplicates count after invalid rows are gone."""
    group = group or []
    checked = validated(df).withColumn("ok", F.size("reasons") == 0)
    seen = Window.partitionBy("ok", "tower_id").orderBy("timestamp", *order)
    again = F.col("ok") & (F.coalesce(F.lag("timestamp").over(seen) == F.col("timestamp"), F.lit(False)))
    checked = checked.withColumn("again", again)
    codes = F.concat(
        F.col("reasons"), F.array(F.lit("input_rows")), F.when(F.col("again"), F.array(F.lit("duplicate_tower_timestamp"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("ok") & ~F.col("again"), F.array(F.lit("valid_rows"))).otherwise(F.array(F.lit("dropped_rows"))),
    )
    return checked.select(*group, F.explode(codes).alias("reason")).groupBy(*group, "reason").agg(F.count("*").alias("rows"))


def merged_report(df: DataFrame, order: list[str], group: str = "source_file_hash") -> DataFrame:
    """The report of every file and, with a null file, of all files together."""
    return report(df, order, [group]).rollup("reason", group).agg(F.sum("rows").alias("rows")).where(F.col("reason").isNotNull())


# Guards by row fail the job that comes upon an offending row; guards of a whole table look at it first.


def _refuse(bad: DataFrame, message: str) -> None:
    row = bad.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def require_role(df: DataFrame, role: str) -> DataFrame:
    """``df``, which fails the job that comes upon a row of another role."""
    return required(df, {"dataset_role": ~F.col("dataset_role").eqNullSafe(role)}, f"rows are not of the role {role}")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    _refuse(df.groupBy(*keys).count().where("count > 1"), "keys are not unique")
    return df


def require_uncorrected(df: DataFrame) -> DataFrame:
    """``df``, which fails the job that comes upon a row that was corrected before."""
    if "correction_stage" not in df.columns:
        return df
    return required(df, {"correction_stage": F.col("correction_stage") != "original"}, "the weather is corrected already")


def shared_files(physical: DataFrame, truth: DataFrame) -> DataFrame:
    """File hashes that both datasets hold."""
    return physical.select("source_file_hash").intersect(truth.select("source_file_hash"))


def require_disjoint(physical: DataFrame, truth: DataFrame) -> None:
    _refuse(shared_files(physical, truth), "physical and truth share a file")


def same_content(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows of either side that the other lacks, and whether the contents are equal."""
    a, b = a.select(columns), b.select(columns)
    only = a.exceptAll(b).select(F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.exceptAll(a).select(F.lit(0), F.lit(1)))
    made = only.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("only_first"), F.coalesce(F.sum("y"), F.lit(0)).alias("only_second"))
    return made.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def missing_columns(df: DataFrame, required: tuple[str, ...], substring: bool = False) -> list[str]:
    have = df.columns
    return [c for c in required if not (any(c in h for h in have) if substring else c in have)]
