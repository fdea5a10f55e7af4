"""Alignment of independent truth with physical weather, backward in time only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.functions.parsing import micros

TRUTH = ("ambient_temp", "wind_speed", "wind_direction", "measurement_height", "source_file_hash")


def asof(physical: DataFrame, truth: DataFrame, minutes: int, order: str = "row_order", by: tuple[str, ...] = ("tower_id",)) -> DataFrame:
    """Every physical row with the latest truth of its tower at or before it, at most
    ``minutes`` old (inclusive); columns of the truth end in _truth, and truth_time, matched
    are added.  Of truth rows at one time the last in order wins.

    Both sides meet in a union and one window by tower: one exchange, no range join.
    """
    have = [c for c in TRUTH if c in truth.columns]
    right = truth.select(*by, F.col("timestamp").alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.struct(F.col("timestamp").alias("truth_time"), *have).alias("_truth"))
    left = physical.select(*by, F.col("timestamp").alias("_t"), F.lit(1).alias("_side"), F.col(order).alias("_o"), F.struct(*physical.columns).alias("_row"))
    last = F.last("_truth", True).over(Window.partitionBy(*by).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_last", last).where("_side = 1")
    near = micros(F.col("_t")) - micros(F.col("_last.truth_time")) <= minutes * 60_000_000
    both = both.withColumn("_last", F.when(near, F.col("_last")))
    return both.select("_row.*", F.col("_last.truth_time").alias("truth_time"), *[F.col(f"_last.{c}").alias(f"{c}_truth") for c in have], F.col("_last").isNotNull().alias("matched"))


def normalise_height(aligned: DataFrame, alpha: float = 0.15, lapse: float = 0.0065) -> DataFrame:
    """Truth wind and temperature at the height of the physical measurement, where the row is
    matched, both heights are positive and both results finite; the raw values are kept.
    A height that one side lacks counts as the same."""
    hp, ht = F.col("measurement_height"), F.col("measurement_height_truth")
    wind = F.col("wind_speed_truth") * F.pow(hp / F.nullif(ht, F.lit(0.0)), F.lit(alpha))
    temp = F.col("ambient_temp_truth") - lapse * (hp - ht)
    ok = F.coalesce(F.col("matched") & (hp > 0) & (ht > 0) & (F.abs(wind) < 1e300) & (F.abs(temp) < 1e300), F.lit(False))
    return aligned.withColumns({
        "wind_speed_truth_raw": F.col("wind_speed_truth"), "ambient_temp_truth_raw": F.col("ambient_temp_truth"), "common_height": F.when(F.col("matched"), F.coalesce(hp, ht)),
        "wind_speed_truth": F.when(ok, wind).otherwise(F.col("wind_speed_truth")), "ambient_temp_truth": F.when(ok, temp).otherwise(F.col("ambient_temp_truth")), "height_normalized": ok,
    })


def report(aligned: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: physical and truth rows, matched, unmatched, coverage (0 without physical rows)."""
    one = aligned.agg(F.count("*").alias("physical_rows"), F.count_if("matched").alias("matched_rows"))
    both = one.crossJoin(truth.agg(F.count("*").alias("truth_rows")))
    share = F.when(F.col("physical_rows") > 0, F.col("matched_rows") / F.col("physical_rows")).otherwise(0.0)
    return both.select("physical_rows", "truth_rows", "matched_rows", (F.col("physical_rows") - F.col("matched_rows")).alias("unmatched_rows"), share.alias("coverage"))


def metrics(aligned: DataFrame, pairs: dict[str, tuple[str, str]], by: str | None = None) -> DataFrame:
    """(by, target, pairs, mae, rmse) of predicted and true columns over finite pairs; with
    ``by``, a null one is the total."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), (F.col(a) - F.col(b)).alias("e")) for k, (a, b) in pairs.items()])).alias("x")
    long = aligned.select(*([by] if by else []), rows).select(*([by] if by else []), "x.*")
    made = long.rollup("target", by) if by else long.groupBy("target")
    e = F.when(F.abs("e") < 1e300, F.col("e"))
    return made.agg(F.count(e).alias("pairs"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).where("target is not null")
