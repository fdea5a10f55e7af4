"""Predictions, registry tables and fallbacks over the given tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwatt.operators import audit, features, matrices, models, quality, registry

from . import checks as c
from . import weather as w
from .checks import CAND, LOCAL
from .views import view
from .weather import _r, r6

#: A key's residual is predicted by its median, if it has so many rows.
ENOUGH = 20


def fitted(spark: SparkSession, sf: str) -> DataFrame:
    """A constant model for each key: the median residual of the matched rows."""
    made = features.residual_bounds(features.residuals(c.aligned(spark, sf)))
    return made.withColumn("outcome", F.when(F.col("rows") >= ENOUGH, "trained").otherwise("data_fallback:too_few_rows"))


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.residuals(c.aligned(spark, sf)).select(*features.KEYS, "timestamp", "physical", "truth")
    model = fitted(spark, sf).where("outcome = 'trained'").select(*features.KEYS, "median")
    both = rows.join(model, list(features.KEYS), "left")
    used = F.col("median").isNotNull()
    return both.withColumns({"final": F.col("physical") + F.coalesce("median", F.lit(0.0)), "used_ai": used, "fallback_reason": F.when(~used, "model_unavailable")}).drop("median")


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Physical, predicted and true values side by side."""
    rows = predicted(spark, sf)
    made = models.comparison(rows.drop("truth"), rows)
    return made.select(*features.KEYS, "timestamp", *[r6(x).alias(x) for x in ("physical", "final", "truth")], "used_ai", "fallback_reason")


def comparison_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The first tower's rows of that table at the common times of its line's readings, for a plot."""
    rows = predicted(spark, sf)
    table = models.comparison(rows.drop("truth"), rows)
    times = w.clean(spark, sf).where(F.minute("timestamp") == 0).select("timestamp")
    tower = rows.agg(F.min("tower_id").alias("t")).first().t
    return matrices.slice_of(table, tower, times).select("tower_id", "target", "timestamp", r6("final").alias("final"), r6("truth").alias("truth"))


def model_run_report(spark: SparkSession, sf: str) -> DataFrame:
    return models.run_report(fitted(spark, sf), predicted(spark, sf))


def final_weather(spark: SparkSession, sf: str) -> DataFrame:
    """What is rated: predicted winds and temperatures where a model was used, local ones elsewhere."""
    made = models.final_weather(c.aligned(spark, sf), predicted(spark, sf))
    return made.select("row_order", *[r6(x).alias(x) for x in ("wind_speed_local", "ambient_temp_local")], *[f"{t}_{x}" for t in ("wind_speed", "ambient_temp") for x in ("used_ai", "fallback_reason")])


def retained_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Of the generations of a key the active one and the latest beside it."""
    k = F.col("created_at")
    g = c.candidates(spark, sf).select(F.col("line_id"), F.lpad((k % 8).cast("string"), 3, "0").alias("tower_id"), "target", F.concat(F.lit("g"), k.cast("string")).alias("generation_id"), "created_at")
    h = g.where("created_at % 3 = 0").groupBy(*features.KEYS).agg(F.min_by("generation_id", "created_at").alias("generation_id"))
    return registry.retained(g, h).select(*features.KEYS, "generation_id", "created_at")


def registry_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a registry table that break its constraints."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k, size = F.col("p_partkey"), F.col("p_size")
    g = p.select(
        k.alias("generation_id"), k.cast("string").alias("tower_id"), F.when(size % 7 == 0, "humidity").when(k % 2 == 0, "wind_speed").otherwise("ambient_temp").alias("target"), F.when(size % 11 == 0, "gone").otherwise("active").alias("status"),
        F.when(size % 13 == 0, "abc").otherwise(F.sha2(k.cast("string"), 256)).alias("model_checksum"), (size % 5).alias("revision"), F.to_json(F.struct(F.when(size % 17 == 0, "x").otherwise(k.cast("string")).alias("tower_id"))).alias("metadata"),
    )
    return registry.violations(g).select("generation_id", "violation")


def keys_to_train(spark: SparkSession, sf: str) -> DataFrame:
    """Keys without a model, or with a provisional one and new data, that were not rejected before."""
    rows, k = c.candidates(spark, sf), F.col("created_at")
    keys = rows.select(*features.KEYS, F.concat(F.lit("d"), (k % 4).cast("string")).alias("data_hash"), (k % 3 != 0).alias("has_holdout"), F.concat(F.lit("a"), (k % 10).cast("string")).alias("attempt_fingerprint"))
    heads = c.heads(spark, sf).select(*features.KEYS, "evaluation", F.concat(F.lit("d"), (k % 6).cast("string")).alias("data_hash"))
    rejected = rows.where("created_at % 10 < 2").select(*features.KEYS, F.concat(F.lit("a"), (k % 10).cast("string")).alias("attempt_fingerprint"))
    return models.to_train(keys, heads, rejected).select(*features.KEYS, "data_hash", "has_holdout", "attempt_fingerprint")


def first_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """The first failed reading of each tower, and of each reason where there is no tower; a fixture hides each fourth tower."""
    rows = quality.validated(view(spark, sf, "weather_raw")).where("size(reasons) > 0")
    rows = rows.select("row_order", F.when(F.col("tower_id").cast("long") % 4 != 0, F.col("tower_id")).alias("tower_id"), F.get("reasons", F.lit(0)).alias("fallback_reason"))
    return audit.first_fallbacks(rows, ["tower_id"], "row_order")


QUERIES = {f.__name__: f for f in (comparison, comparison_slice, model_run_report, final_weather, retained_generations, registry_violations, keys_to_train, first_fallbacks)}

_PREDICTED = f"""{LOCAL}, fit as (select line_id, tower_id, target, count(*) as rows, quantile_cont(true_value - physical, 0.5) as med from resid group by 1, 2, 3),
pred as (select r.line_id, r.tower_id, r.target, r.timestamp, r.row_order, physical, true_value as truth, physical + case when rows >= {ENOUGH} then med else 0 end as final, rows >= {ENOUGH} as used from resid r join fit using (line_id, tower_id, target))"""


def _final(target: str, column: str) -> str:
    return f"coalesce({target}.final, {column})"


SQL = {
    "comparison": f"with {_PREDICTED} select line_id, tower_id, target, timestamp, {_r('physical')} as physical, {_r('final')} as final, {_r('truth')} as truth, used as used_ai, case when not used then 'model_unavailable' end as fallback_reason from pred",
    "comparison_slice": f"with {_PREDICTED} select tower_id, target, timestamp, {_r('final')} as final, {_r('truth')} as truth from pred where tower_id = (select min(tower_id) from pred) and timestamp in (select timestamp from clean where minute(timestamp) = 0)",
    "model_run_report": f"""with {_PREDICTED}, used as (select count(distinct (line_id, tower_id, target)) as used_models, string_agg(distinct target, ',' order by target) as used_targets from pred where used)
        select count(*) filter (rows >= {ENOUGH}) as trained, count(*) as models, any_value(used_models) as used_models, coalesce(any_value(used_targets), '') as used_targets from fit, used""",
    "final_weather": f"""with {_PREDICTED}, w as (select * from pred where target = 'wind_speed'), a as (select * from pred where target = 'ambient_temp')
        select l.row_order, {_r("case when w.used then w.final else wind_l end")} as wind_speed_local, {_r("case when a.used then a.final else temp_l end")} as ambient_temp_local, coalesce(w.used, false) as wind_speed_used_ai, case when not coalesce(w.used, false) then 'model_unavailable' end as wind_speed_fallback_reason,
            coalesce(a.used, false) as ambient_temp_used_ai, case when not coalesce(a.used, false) then 'model_unavailable' end as ambient_temp_fallback_reason from levelled l left join w on w.row_order = l.row_order left join a on a.row_order = l.row_order""",
    "retained_generations": f"""with {CAND}, g as (select line_id, lpad((k % 8)::varchar, 3, '0') as tower_id, target, 'g' || k::varchar as generation_id, k as created_at from cand), h as (select line_id, tower_id, target, arg_min(generation_id, created_at) as active from g where created_at % 3 = 0 group by 1, 2, 3)
        select line_id, tower_id, target, generation_id, created_at from g left join h using (line_id, tower_id, target) qualify row_number() over (partition by line_id, tower_id, target order by coalesce(generation_id = active, false) desc, created_at desc, generation_id) <= 2""",
    "registry_violations": """select * from (select p_partkey as generation_id, case when p_size % 7 = 0 then 'target' when p_size % 11 = 0 then 'status' when p_size % 13 = 0 then 'checksum' when p_size % 5 <= 0 then 'revision' when p_size % 17 = 0 then 'metadata' end as violation from part) where violation is not null""",
    "keys_to_train": f"""with {CAND}, h as (select line_id, tower_id, target, h_eval, 'd' || (k % 6)::varchar as hd from heads join (select line_id, tower_id, target, k from cand) using (line_id, tower_id, target))
        select line_id, tower_id, target, 'd' || (k % 4)::varchar as data_hash, k % 3 <> 0 as has_holdout, 'a' || (k % 10)::varchar as attempt_fingerprint from cand left join h using (line_id, tower_id, target)
        where k % 10 >= 2 and (h_eval is null or (h_eval = 'full_fit' and k % 3 <> 0 and 'd' || (k % 4)::varchar <> hd))""",
    "first_fallbacks": f"""with {w.RAW}, f as (select row_order, case when tower_id::bigint % 4 <> 0 then tower_id end as tower_id, reasons[1] as fallback_reason from checked where len(reasons) > 0)
        select row_order, tower_id, fallback_reason from f qualify row_number() over (partition by coalesce(tower_id, 'reason:' || fallback_reason) order by row_order) = 1""",
}
