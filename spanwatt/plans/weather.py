"""The ratings job from weather to bottleneck, its queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwatt.config import CLEAR_SKY, Conductor, Correction
from spanwatt.functions import physics
from spanwatt.operators import correction, quality, ratings, resample, terrain

from .views import sql, view

GRID = terrain.Affine(100.0, 40.0, 0.01, 0.01)
WIRE = Conductor.named("ACSR Drake (795 kcmil)")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, and never -0; engines round halves differently, so these are moved off."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits) + F.lit(0.0)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return quality.clean_weather(view(spark, sf, "weather_raw"))


def resampled(spark: SparkSession, sf: str, minutes: int = 30) -> DataFrame:
    return resample.resample(clean(spark, sf).drop("row_order"), minutes)


def tower_terrain(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.sample(terrain.tower_coordinates(view(spark, sf, "tower_coords_raw")), view(spark, sf, "dem_cells"), GRID)


def corrected(spark: SparkSession, sf: str, options: Correction = Correction(desert=True, ground_temp_offset=5.0)) -> DataFrame:
    return correction.correct(terrain.join_terrain(resampled(spark, sf), tower_terrain(spark, sf)), options)


def rated(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """only: towers and times; nothing else is corrected and rated."""
    if only is None:
        return ratings.rate_steady(ratings.common_times(corrected(spark, sf), clean(spark, sf)), WIRE)
    grid = ratings.common_times(resampled(spark, sf), clean(spark, sf))
    place = F.row_number().over(Window.partitionBy("tower_id").orderBy("timestamp")) - 1
    grid = ratings.first_elevation(grid).withColumn("position", place).join(only, ["tower_id", "timestamp"], "left_semi")
    df = correction.correct(terrain.join_terrain(grid, tower_terrain(spark, sf)), Correction(desert=True, ground_temp_offset=5.0))
    # a tower's terrain has one elevation; the weather's counts where it has none
    df = df.withColumn("rated_elevation", F.when(F.col("terrain_source") == "weather", F.col("rated_elevation")).otherwise(F.col("elevation")))
    return ratings.rate_steady(df, WIRE)


# ------------------------------------------------------------------ queries


def qc_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validated(view(spark, sf, "weather_raw")).select("row_order", F.array_join("reasons", ",").alias("reasons"), "wind_direction")


def qc_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.merged_report(view(spark, sf, "weather_raw"), ["row_order"]).select(F.coalesce("source_file_hash", F.lit("all")).alias("file"), "reason", "rows")


def dedup_weather(spark: SparkSession, sf: str) -> DataFrame:
    return clean(spark, sf).select("tower_id", "timestamp", "row_order", "solar_radiation", "humidity")


def resample_weather(spark: SparkSession, sf: str) -> DataFrame:
    made = resampled(spark, sf)
    return made.select("line_id", "tower_id", "timestamp", *[r6(c).alias(c) for c in ("ambient_temp", "wind_speed", "solar_radiation", "humidity", "elevation")], "source_file_hash")


def circular_direction(spark: SparkSession, sf: str) -> DataFrame:
    return resampled(spark, sf, 50).select("tower_id", "timestamp", r6("wind_direction", 4).alias("wind_direction"))


def lineage_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return resample.source_hashes(clean(spark, sf), ("line_id",)).select("line_id", F.array_join("source_hashes", ",").alias("source_hashes"))


def common_axis(spark: SparkSession, sf: str) -> DataFrame:
    made = resample.common_axis(clean(spark, sf), 30)
    return made.select("tower_id", "step", *[r6(c, 4).alias(c) for c in ("ambient_temp", "wind_speed", "wind_direction", "solar_radiation", "elevation")])


def tower_places(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.tower_coordinates(view(spark, sf, "tower_coords_raw"))


def terrain_slope(spark: SparkSession, sf: str) -> DataFrame:
    made = tower_terrain(spark, sf)
    return made.select("tower_id", r6("slope").alias("slope"), r6("aspect").alias("aspect"), "terrain_elevation", "terrain_source")


def corrected_weather(spark: SparkSession, sf: str) -> DataFrame:
    made = corrected(spark, sf)
    return made.select("tower_id", "timestamp", *[r6(c).alias(c) for c in ("wind_speed_local", "ambient_temp_local", "solar_radiation_local", "wind_angle_deg", "terrain_wind_factor", "vertical_wind_factor", "elevation")], "terrain_source", "correction_stage")


def correction_effect(spark: SparkSession, sf: str) -> DataFrame:
    made = correction.effect(corrected(spark, sf))
    return made.select("tower_id", *[r6(c).alias(c) for c in made.columns[1:]])


def solar_effect(spark: SparkSession, sf: str) -> DataFrame:
    made = correction.solar_effect(corrected(spark, sf))
    return made.select("tower_id", *[r6(c).alias(c) for c in made.columns[1:]])


def combined_factor(spark: SparkSession, sf: str) -> DataFrame:
    return correction.combined_factor(corrected(spark, sf)).select("tower_id", "timestamp", r6("combined_factor").alias("combined_factor"))


def heat_balance(spark: SparkSession, sf: str) -> DataFrame:
    df = corrected(spark, sf)
    parts = physics.heat_balance(WIRE, F.lit(80.0), F.col("ambient_temp_local"), F.col("wind_speed_local"), F.col("wind_angle_deg"), F.col("elevation"), F.col("solar_radiation_local"))
    return df.select("tower_id", "timestamp", r6(physics.wind_angle_factor(F.col("wind_angle_deg"))).alias("angle_factor"), *[r6(v, 9 if k == "resistance" else 5).alias(k) for k, v in parts.items()])


def resistance(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("wind_direction") / 2.0
    return clean(spark, sf).select("tower_id", "timestamp", r6(physics.resistance(WIRE, t) * 1e6, 5).alias("micro_ohm_per_m"))


def heat_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Of a conductor whose masses are read from the table part."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    materials = F.array(F.struct(F.lit("aluminum").alias("type"), (F.col("p_size") / 10.0).alias("mass")), F.struct(F.when(F.col("p_size") % 2 == 0, "steel").otherwise("copper").alias("type"), (F.col("p_retailprice") / 1000.0).alias("mass")))
    return part.select("p_partkey", r6(physics.heat_capacity(materials)).alias("heat_capacity"))


def clear_sky_gain(spark: SparkSession, sf: str) -> DataFrame:
    df = clean(spark, sf).join(tower_places(spark, sf), "tower_id")
    day, hour = F.dayofyear("timestamp").cast("double"), F.hour("timestamp") + F.minute("timestamp") / 60.0
    gain = physics.clear_sky_gain(WIRE, F.col("lat"), day, hour, F.col("elevation"), F.lit(90.0))
    rise, down = physics.sunrise_sunset(F.col("lat"), day)
    return df.select("tower_id", "timestamp", r6(gain, 5).alias("q_solar"), r6(physics.solar_azimuth(F.col("lat"), day, hour), 5).alias("azimuth"), rise.alias("sunrise"), down.alias("sunset"))


def steady_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return rated(spark, sf).select("line_id", "tower_id", "timestamp", r6("raw_rating_a", 4).alias("raw_rating_a"), r6("rating_a", 4).alias("rating_a"), "safety_factor")


def line_bottleneck(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.bottleneck(rated(spark, sf)).withColumn("line_rating_a", r6("line_rating_a", 4))


def line_rating_summary(spark: SparkSession, sf: str) -> DataFrame:
    made = ratings.line_summary(ratings.bottleneck(rated(spark, sf)))
    return made.select("line_id", "times", *[r6(c, 4).alias(c) for c in ("min_a", "max_a", "mean_a")])


def tower_summary(spark: SparkSession, sf: str) -> DataFrame:
    made = ratings.tower_summary(corrected(spark, sf))
    return made.select("tower_id", *[r6(c).alias(c) for c in made.columns[1:]])


def daylight_hours(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.daylight_hours(clean(spark, sf))


def common_times(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.common_times(resampled(spark, sf)).groupBy("line_id").agg(F.count("*").alias("rows"), F.countDistinct("timestamp").alias("times"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def incomplete_towers(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.incomplete_towers(resampled(spark, sf), "solar_radiation")


QUERIES = {
    f.__name__: f
    for f in (
        qc_rows, qc_reason_counts, dedup_weather, resample_weather, circular_direction, lineage_hashes, common_axis, tower_places, terrain_slope, corrected_weather,
        correction_effect, solar_effect, combined_factor, heat_balance, resistance, heat_capacity, clear_sky_gain, steady_ratings, line_bottleneck,
        line_rating_summary, tower_summary, daylight_hours, common_times, incomplete_towers,
    )
}

# ------------------------------------------------------------------ SQL


def _r(x: str, digits: int = 6) -> str:
    return f"round({x} + 1e-9, {digits}) + 0.0::double"


RAW = f"""raw as ({sql("weather_raw", "duckdb")}),
checked as (
    select * replace (case when wind_direction = 360 then 0.0::double else wind_direction end as wind_direction), list_filter([
        case when tower_id is null then 'invalid_tower_id' end, case when timestamp is null then 'invalid_timestamp' end,
        case when ambient_temp is null then 'missing_ambient_temp' end, case when wind_speed is null then 'missing_wind_speed' end, case when wind_direction is null then 'missing_wind_direction' end,
        case when wind_speed not between 0 and 75 then 'wind_speed_out_of_range' end, case when ambient_temp not between -60 and 70 then 'ambient_temp_out_of_range' end,
        case when wind_direction not between 0 and 360 then 'wind_direction_out_of_range' end, case when humidity not between 0 and 100 then 'humidity_out_of_range' end,
        case when solar_radiation < 0 then 'solar_radiation_out_of_range' end], lambda x: x is not null) as reasons
    from (select * replace (coalesce(solar_radiation, 0.0::double) as solar_radiation, coalesce(humidity, 50.0::double) as humidity) from raw)
),
ranked as (select *, row_number() over (partition by tower_id, timestamp order by row_order) as rn from checked where len(reasons) = 0),
clean as (select * exclude (reasons, rn) from ranked where rn = 1)"""


def _grid(minutes: int) -> str:
    step = minutes * 60_000_000
    cols = ("ambient_temp", "wind_speed", "solar_radiation", "humidity")
    nearest = ", ".join(
        f"last_value({c} ignore nulls) over up as {c}_a, first_value({c} ignore nulls) over down as {c}_b, "
        f"last_value(case when {c} is not null then t end ignore nulls) over up as {c}_ta, first_value(case when {c} is not null then t end ignore nulls) over down as {c}_tb"
        for c in (*cols, "elevation", "sn", "cs")
    )
    lin = lambda c: f"case when g = {c}_ta then {c}_a else {c}_a + ({c}_b - {c}_a) * (g - {c}_ta) / ({c}_tb - {c}_ta) end"
    return f"""timed as (select *, epoch_us(timestamp) as t, min(epoch_us(timestamp)) over (partition by tower_id) as t0, sin(radians(wind_direction)) as sn, cos(radians(wind_direction)) as cs from clean),
near as (
    select tower_id, line_id, t, t0, lead(t) over (partition by tower_id order by t) as nt, {nearest}, source_file_hash
    from timed
    window up as (partition by tower_id order by t rows unbounded preceding), down as (partition by tower_id order by t rows between 1 following and unbounded following)
),
points as (
    select *, t0 + unnest(case when nt is null and (t - t0) % {step} <> 0 then [t - t0]
        else list_transform(range((t - t0 + {step} - 1) // {step}, coalesce((nt - t0 + {step} - 1) // {step}, (t - t0) // {step} + 1)), lambda k: k * {step}) end) as g
    from near
),
grid as (
    select tower_id, line_id, make_timestamp(g) as timestamp, {", ".join(f"{lin(c)} as {c}" for c in (*cols, "elevation"))},
        {lin("sn")} as sn, {lin("cs")} as cs, source_file_hash
    from points
),
resampled as (
    select * exclude (sn, cs), case when sqrt(sn * sn + cs * cs) > 1e-12 then case when (degrees(atan2(sn, cs)) + 360) % 360 >= 360 then 0 else (degrees(atan2(sn, cs)) + 360) % 360 end end as wind_direction from grid
)"""


PLACES = f"""places as (
    select tower_id, min(lon) as lon, min(lat) as lat from (select regexp_extract(label, '([0-9]+)$', 1) as tower_id, lon, lat from ({sql("tower_coords_raw", "duckdb")}))
    group by 1 having min(lon) = max(lon) and min(lat) = max(lat)
)"""
TERRAIN = f"""{PLACES},
dem as (select row, col, elevation as z from ({sql("dem_cells", "duckdb")}) where not masked),
spots as (select tower_id, floor((lon - 100.0::double) / 0.01::double)::bigint as c0, floor((40.0::double - lat) / 0.01::double)::bigint as r0 from places),
around as (
    select tower_id, dr, dc, z, radians(0.01::double) * dc * 6378137.0::double / sqrt(w) * cos(radians(la)) as e,
        -radians(0.01::double) * dr * 6378137.0::double * (1 - 0.0066943799901413165::double) / pow(w, 1.5::double) as n
    from (select *, 1 - 0.0066943799901413165::double * pow(sin(radians(la)), 2) as w from (
        select *, 40.0::double - (r0 + 0.5::double) * 0.01::double as la from spots, (select unnest([-1, 0, 1]) as dr), (select unnest([-1, 0, 1]) as dc)
    )) join dem on dem.row = r0 + dr and dem.col = c0 + dc
),
moments as (
    select tower_id, count(*) as k, max(z) filter (dr = 0 and dc = 0) as centre, sum(e * e) - sum(e) * sum(e) / count(*) as ee, sum(n * n) - sum(n) * sum(n) / count(*) as nn,
        sum(e * n) - sum(e) * sum(n) / count(*) as en, sum(e * z) - sum(e) * sum(z) / count(*) as ez, sum(n * z) - sum(n) * sum(z) / count(*) as nz from around group by 1
),
slopes as (
    select *, case when k >= 3 and ee * nn - en * en > 1e-6 * pow(ee + nn, 2) then (ez * nn - nz * en) / (ee * nn - en * en) else 0 end as ge,
        case when k >= 3 and ee * nn - en * en > 1e-6 * pow(ee + nn, 2) then (nz * ee - ez * en) / (ee * nn - en * en) else 0 end as gn from moments
),
terrain as (
    select tower_id, case when centre is not null and sqrt(ge * ge + gn * gn) > 1e-9 then degrees(atan(sqrt(ge * ge + gn * gn))) else 0.0::double end as slope,
        case when centre is not null and sqrt(ge * ge + gn * gn) > 1e-9 and (degrees(atan2(-ge, -gn)) + 360) % 360 < 360 - 1e-9 then (degrees(atan2(-ge, -gn)) + 360) % 360 else 0.0::double end as aspect,
        coalesce(centre, 1000.0::double) as terrain_elevation, case when centre is not null then 'dem' else 'default' end as terrain_source
    from places left join slopes using (tower_id)
)"""
CORRECTED = f"""{RAW},
{_grid(30)},
{TERRAIN},
placed as (
    select r.* replace (coalesce(t.terrain_elevation, r.elevation) as elevation), coalesce(slope, 0.0::double) as slope, coalesce(aspect, 0.0::double) as aspect, coalesce(terrain_source, 'weather') as terrain_source
    from resampled r left join terrain t using (tower_id)
),
factored as (
    select *, pow(2.0::double, 0.15::double) as vf, ambient_temp - 0.0065::double * 10 as temp_l,
        case when slope < 2 then 1.0::double when cos(radians(wind_direction - aspect)) < -0.5 then 1 + least(slope / 45 * 0.4::double, 0.3::double)
            when cos(radians(wind_direction - aspect)) > 0.5 then 1 - least(slope / 45 * 0.4::double, 0.3::double) else 1.0::double end as tf,
        abs((wind_direction - 90 + 360) % 360) as gap
    from placed
),
corrected as (
    select *, wind_speed * vf * tf as wind_l, least(gap, 360 - gap, abs(180 - gap)) as angle,
        greatest(solar_radiation * (1 + 0.35::double * 0.3::double) + 5.67e-8 * (pow(temp_l + 273.15::double + 5, 4) - pow(temp_l + 273.15::double, 4)) * 0.15::double, 0) as solar_l
    from factored
)"""


def _balance(source: str, elevation: str) -> str:
    c = WIRE
    return f"""(
        select *, sqrt(greatest(qc + qr - qs, 0) / res) as amp from (
            select *, sgn * q1 as qn, sgn * q2 as ql, sgn * q3 as qh, sgn * greatest(q1, q2, q3) as qc,
                17.8::double * {c.diameter}::double * 0.8::double * (pow(353.0::double / 100, 4) - pow((temp_l + 273) / 100, 4)) as qr, 0.8::double * solar_l * {c.diameter}::double as qs,
                {c.r25}::double + ({c.r75}::double - {c.r25}::double) / 50 * 55 as res
            from (
                select *, 3.645::double * sqrt(rho) * pow({c.diameter}::double, 0.75::double) * pow(dt, 1.25::double) as q1,
                    case when wind_l = 0 then 0.0::double else ka * (1.01::double + 1.35::double * pow(re, 0.52::double)) * kf * dt end as q2,
                    case when wind_l = 0 then 0.0::double else ka * 0.754::double * pow(re, 0.6::double) * kf * dt end as q3
                from (
                    select *, {c.diameter}::double * rho * wind_l / mu as re from (
                        select *, (1.293::double - 1.525e-4 * el + 6.379e-9 * el * el) / (1 + 0.00367::double * tm) as rho,
                            1.458e-6 * pow(tm + 273.15::double, 1.5::double) / (tm + 383.4::double) as mu, 2.424e-2::double + 7.477e-5 * tm - 4.407e-9 * tm * tm as kf,
                            1.194::double - cos(radians(angle)) + 0.194::double * cos(2 * radians(angle)) + 0.368::double * sin(2 * radians(angle)) as ka
                        from (select *, (80 + temp_l) / 2 as tm, abs(80 - temp_l) as dt, case when 80 < temp_l then -1 else 1 end as sgn, {elevation} as el from {source})
                    )
                )
            )
        )
    )"""


RATED = f"""{CORRECTED},
complete as (
    select line_id, timestamp from corrected join (select line_id, count(distinct tower_id) as towers from corrected group by 1) using (line_id) group by 1, 2 having count(*) = any_value(towers)
),
shared as (select * from corrected semi join complete using (line_id, timestamp)),
elevated as (select *, first_value(elevation) over (partition by tower_id order by timestamp) as first_elevation from shared),
rated as (select *, amp * 0.8::double as rating from {_balance("elevated", "first_elevation")}),
bottleneck as (
    select line_id, timestamp, min(rating) as line_rating_a, arg_min(tower_id, (rating, tower_id)) as bottleneck_tower, count(*) as towers from rated group by 1, 2
)"""

_SKY = "+".join(f"({c}::double) * pow(alt, {k})" for k, c in enumerate(CLEAR_SKY))

SQL = {
    "qc_rows": f"with {RAW} select row_order, array_to_string(reasons, ',') as reasons, wind_direction from checked",
    "qc_reason_counts": f"""with {RAW}, flags as (
        select source_file_hash, list_concat(reasons, ['input_rows'], case when len(reasons) = 0 and rn > 1 then ['duplicate_tower_timestamp'] else [] end,
            case when len(reasons) = 0 and rn = 1 then ['valid_rows'] else ['dropped_rows'] end) as codes
        from checked left join (select row_order, rn from ranked) using (row_order)
    ), long as (select source_file_hash, unnest(codes) as reason from flags)
    select coalesce(source_file_hash, 'all') as file, reason, count(*) as rows from long group by grouping sets ((source_file_hash, reason), (reason))""",
    "dedup_weather": f"with {RAW} select tower_id, timestamp, row_order, solar_radiation, humidity from clean",
    "resample_weather": f"with {RAW}, {_grid(30)} select line_id, tower_id, timestamp, {', '.join(f'{_r(c)} as {c}' for c in ('ambient_temp', 'wind_speed', 'solar_radiation', 'humidity', 'elevation'))}, source_file_hash from resampled",
    "circular_direction": f"with {RAW}, {_grid(50)} select tower_id, timestamp, {_r('wind_direction', 4)} as wind_direction from resampled",
    "lineage_hashes": f"with {RAW} select line_id, string_agg(distinct source_file_hash, ',' order by source_file_hash) as source_hashes from clean group by 1",
    "common_axis": f"""with {RAW}, ends as (select min(epoch_us(timestamp))::double as t0, max(epoch_us(timestamp))::double as t1 from clean),
    axis as (select unnest(range(n)) as step, t0, t1, n from (select *, floor((t1 - t0) / 1.8e9)::bigint + 1 as n from ends)),
    points as (select tower_id, step, t0 + (t1 - t0) * step / greatest(n - 1, 1) as t, elevation from axis, (select tower_id, avg(elevation) as elevation from clean group by 1)),
    readings as (select tower_id, epoch_us(timestamp)::double as rt, ambient_temp as a, wind_speed as w, solar_radiation as s, wind_direction as d from clean),
    low as (select p.*, r.rt as t_a, r.a as a_a, r.w as w_a, r.s as s_a, r.d as d_a from points p asof left join readings r on p.tower_id = r.tower_id and p.t >= r.rt),
    both_ as (select p.*, r.rt as t_b, r.a as a_b, r.w as w_b, r.s as s_b, r.d as d_b from low p asof left join readings r on p.tower_id = r.tower_id and p.t <= r.rt),
    made as (
        select tower_id, step, elevation, {", ".join(f"case when t_a is null then {c}_b when t_b is null or t_a = t_b then {c}_a else {c}_a + ({c}_b - {c}_a) * (t - t_a) / (t_b - t_a) end as {c}" for c in "awsd")} from both_
    ), solar as (select step, avg(least(greatest(s, 0), 1500)) as solar_radiation from made group by 1)
    select tower_id, step::integer as step, {_r("least(greatest(a, -50), 70)", 4)} as ambient_temp, {_r("least(greatest(w, 0.1::double), 20)", 4)} as wind_speed, {_r("d % 360", 4)} as wind_direction,
        {_r("solar_radiation", 4)} as solar_radiation, {_r("elevation", 4)} as elevation from made join solar using (step)""",
    "tower_places": f"with {PLACES} select * from places",
    "terrain_slope": f"with {TERRAIN} select tower_id, {_r('slope')} as slope, {_r('aspect')} as aspect, terrain_elevation, terrain_source from terrain",
    "corrected_weather": f"""with {CORRECTED} select tower_id, timestamp, {_r("wind_l")} as wind_speed_local, {_r("temp_l")} as ambient_temp_local, {_r("solar_l")} as solar_radiation_local,
        {_r("angle")} as wind_angle_deg, {_r("tf")} as terrain_wind_factor, {_r("vf")} as vertical_wind_factor, {_r("elevation")} as elevation, terrain_source, 'terrain_corrected' as correction_stage from corrected""",
    "correction_effect": f"""with {CORRECTED} select tower_id, {_r("avg(wind_speed)")} as wind_before, {_r("avg(wind_l)")} as wind_after,
        {_r("case when avg(wind_speed) > 0 then (avg(wind_l) - avg(wind_speed)) / avg(wind_speed) * 100 else 0 end")} as change_percent,
        {_r("avg(vf)")} as vertical_factor, {_r("avg(tf)")} as terrain_factor, {_r("1.0::double")} as direction_factor from corrected group by 1""",
    "solar_effect": f"""with {CORRECTED} select tower_id, {_r("avg(solar_radiation)")} as solar_before, {_r("avg(solar_l)")} as solar_after, {_r("avg(solar_l) - avg(solar_radiation)")} as solar_delta from corrected group by 1""",
    "combined_factor": f"with {CORRECTED} select tower_id, timestamp, {_r('vf * tf')} as combined_factor from corrected",
    "heat_balance": f"""with {CORRECTED} select tower_id, timestamp, {_r("ka")} as angle_factor, {_r("qn", 5)} as q_natural, {_r("ql", 5)} as q_low, {_r("qh", 5)} as q_high, {_r("qc", 5)} as q_convection,
        {_r("qr", 5)} as q_radiation, {_r("qs", 5)} as q_solar, {_r("res", 9)} as resistance, {_r("amp", 5)} as current_a from {_balance("corrected", "elevation")}""",
    "resistance": f"""with {RAW} select tower_id, timestamp, {_r(f"1e6 * ({WIRE.r25}::double + (wind_direction / 2 - 25) * case when wind_direction / 2 <= 100 then ({WIRE.r75}::double - {WIRE.r25}::double) / 50 else ({WIRE.r200}::double - {WIRE.r25}::double) / 175 end)", 5)} as micro_ohm_per_m from clean""",
    "heat_capacity": f"select p_partkey, {_r('p_size / 10.0::double * 955 + p_retailprice / 1000.0::double * case when p_size % 2 = 0 then 476 else 423 end')} as heat_capacity from part",
    "clear_sky_gain": f"""with {RAW}, {PLACES}, sun as (
        select *, radians(lat) as la, radians(23.45::double * sin(radians((dayofyear(timestamp) + 284.0::double) / 365 * 360))) as de, radians((hour(timestamp) + minute(timestamp) / 60.0::double - 12) * 15) as om
        from clean join places using (tower_id)
    ), up as (
        select *, greatest(0, degrees(asin(least(greatest(cos(la) * cos(de) * cos(om) + sin(la) * sin(de), -1), 1)))) as alt,
            (degrees(atan2(sin(om), sin(la) * cos(om) - cos(la) * tan(de))) + 180) % 360 as az, degrees(acos(greatest(-1, least(1, -tan(la) * tan(de))))) / 15 as half from sun
    )
    select tower_id, timestamp, {_r(f"case when alt <= 0 then 0 else 0.8::double * greatest(0, {_SKY}) * (1 + 1.148e-4 * elevation - 1.108e-8 * elevation * elevation) * sin(acos(greatest(-1, least(1, cos(radians(alt)) * cos(radians(az - 90)))))) * {WIRE.diameter}::double end", 5)} as q_solar,
        {_r("az", 5)} as azimuth, round(12 - half, 1) as sunrise, round(12 + half, 1) as sunset from up""",
    "steady_ratings": f"with {RATED} select line_id, tower_id, timestamp, {_r('amp', 4)} as raw_rating_a, {_r('rating', 4)} as rating_a, 0.8::double as safety_factor from rated",
    "line_bottleneck": f"with {RATED} select * replace ({_r('line_rating_a', 4)} as line_rating_a) from bottleneck",
    "line_rating_summary": f"with {RATED} select line_id, count(*) as times, {_r('min(line_rating_a)', 4)} as min_a, {_r('max(line_rating_a)', 4)} as max_a, {_r('avg(line_rating_a)', 4)} as mean_a from bottleneck group by 1",
    "tower_summary": f"""with {CORRECTED} select tower_id, {_r("avg(wind_l)")} as mean_wind, {_r("max(temp_l)")} as max_temp, {_r("arg_min(elevation, timestamp)")} as elevation,
        {_r("arg_min(slope, timestamp)")} as slope, {_r("arg_min(aspect, timestamp)")} as aspect from corrected group by 1""",
    "daylight_hours": f"""with {RAW}, s as (select line_id, timestamp, avg(solar_radiation) as s from clean group by 1, 2)
        select line_id, coalesce(min(hour(timestamp) + minute(timestamp) / 60.0::double) filter (s > 10), 6) as first_hour, coalesce(max(hour(timestamp) + minute(timestamp) / 60.0::double) filter (s > 10), 18) as last_hour from s group by 1""",
    "common_times": f"""with {RAW}, {_grid(30)}, complete as (
        select line_id, timestamp, count(*) as n from resampled join (select line_id, count(distinct tower_id) as towers from resampled group by 1) using (line_id) group by 1, 2 having count(*) = any_value(towers)
    ) select line_id, sum(n)::bigint as rows, count(*) as times, min(timestamp) as first, max(timestamp) as last from complete group by 1""",
    "incomplete_towers": f"""with {RAW}, {_grid(30)} select line_id, tower_id, times - have as lacking from (select line_id, tower_id, count(solar_radiation) as have from resampled group by 1, 2)
        join (select line_id, count(distinct timestamp) as times from resampled group by 1) using (line_id) where have < times""",
}
