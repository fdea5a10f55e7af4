"""Audit events: append-only, and never in the way of results."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANDATORY = ("run_id", "result_id", "line_id", "tower_id", "stage", "input_hash", "config_hash", "source")


def events(df: DataFrame, stage: str, details: list[str]) -> DataFrame:
    """Events out of result rows: mandatory fields must be filled, details become JSON."""
    ok = F.lit(True)
    for c in MANDATORY:
        if c != "stage":
            ok &= F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    optional = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("fallback_reason", "error_code")]
    return df.where(ok).select(*[F.lit(stage).alias("stage") if c == "stage" else F.col(c) for c in MANDATORY], *optional, F.current_timestamp().alias("timestamp"), F.to_json(F.struct(*details)).alias("details"))


def append(log: DataFrame, path: str) -> bool:
    """Appends; a failure is logged and does not change any result."""
    try:
        log.write.mode("append").json(path)
        return True
    except Exception:
        logging.getLogger(__name__).exception("the audit log was not written")
        return False


def summary(log: DataFrame) -> DataFrame:
    """Events by stage and fallback reason, with all subtotals (null: all)."""
    return log.cube("stage", F.coalesce("fallback_reason", F.lit("none")).alias("fallback_reason")).agg(F.count("*").alias("events"))


def first_fallbacks(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Fallbacks without repetition: the first of each key, or of each reason where there is no key."""
    has_key = F.lit(False)
    for c in key:
        has_key |= F.col(c).isNotNull()
    unit = F.when(has_key, F.to_json(F.struct(*key))).otherwise(F.concat(F.lit("reason:"), "fallback_reason"))
    return df.withColumn("_u", unit).groupBy("_u").agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")
