"""Sag checks of published ratings against inclination readings."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.config import EARTH_RADIUS_M, GRAVITY, SAG, Conductor
from spanwatt.functions import physics

from .chains import ROWS, fold, let
from .quality import require_unique

#: Columns that may hold the current that a line carried, the first one counts.
OPERATING = ("operating_currents", "actual_currents", "measured_currents")


def snapshot(rated: DataFrame, coords: DataFrame, checked: bool = False) -> DataFrame:
    """Frozen inputs by tower and time: published rating, local weather, the current that the
    line carried (the first column of OPERATING there is, if it is not negative), position in the axis.

    rated may hold a column position, where it is a part of its axis.  checked: fail on a tower that
    has a time twice, at the cost of a look at the data.
    """
    if checked:
        require_unique(rated, ["tower_id", "timestamp"])
    place = F.col("position") if "position" in rated.columns else F.row_number().over(Window.partitionBy("tower_id").orderBy("timestamp")) - 1
    carried = next((F.when(F.col(c).between(0.0, 1e300), F.col(c)) for c in OPERATING if c in rated.columns), F.lit(None).cast("double"))
    # a null in place of a filter, which Spark would push below the heat balance with all of its terms
    rows = rated.select("line_id", "tower_id", "timestamp", F.when(F.col("rating_a") >= 0.0, F.col("rating_a")).alias("snapshot_current_a"), carried.alias("carried_current_a"), F.col("ambient_temp_local").alias("snapshot_temp_c"), F.col("wind_speed_local").alias("snapshot_wind"), "wind_angle_deg", F.col("solar_radiation_local").alias("solar_radiation"), F.col("rated_elevation").alias("elevation"), place.cast("long").alias("position"))
    return rows.join(coords, "tower_id", "left")


def spans(towers: DataFrame) -> DataFrame:
    """Per tower the length to the next tower of its line, of the last one to the one before,
    else the default; and where it comes from.  towers: line_id, tower_id, lon, lat, null where a tower has no place."""
    order = Window.partitionBy("line_id").orderBy("tower_id")
    last = F.lead("tower_id").over(order).isNull()
    df = towers.withColumns({f"{c}2": F.when(last, F.lag(c).over(order)).otherwise(F.lead(c).over(order)) for c in ("lon", "lat")})
    half_lat, half_lon = F.radians(F.col("lat2") - F.col("lat")) / 2, F.radians(F.col("lon2") - F.col("lon")) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians("lat")) * F.cos(F.radians("lat2")) * F.pow(F.sin(half_lon), F.lit(2.0))
    length = 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
    return df.select("line_id", "tower_id", F.coalesce(F.when(length > 0, length), F.lit(SAG["span_m"])).alias("span_m"), F.when(length > 0, "derived").otherwise("default").alias("span_source"))


def unit_weight(measured: Column, row_mass: Column, catalogue_mass: Column, materials: Column) -> tuple[Column, Column]:
    """N/m and its source: measured, else from the first known mass, else the default mass."""
    total = F.aggregate(materials, F.lit(0.0), lambda s, m: s + m["mass"])
    mass = F.coalesce(F.when(row_mass > 0, row_mass), F.when(catalogue_mass > 0, catalogue_mass), F.when(total > 0, total))
    value = F.coalesce(F.when(measured > 0, measured), mass * GRAVITY, F.lit(SAG["unit_mass_kg_m"] * GRAVITY))
    return value, F.when(measured > 0, "measured").when(mass.isNotNull(), "derived").otherwise("default")


#: What a value must be to count, else the next source is asked.
COUNTS = {"positive": lambda c: F.when((c > 0.0) & finite(c), c), "finite": lambda c: F.when(finite(c), c), "nonnegative": lambda c: F.when((c >= 0.0) & finite(c), c)}


def resolved(df: DataFrame, parameters: dict[str, tuple[str, Column | None, Column | None, float | None]]) -> DataFrame:
    """Each parameter from the row or the catalogue (measured), else derived, else its default.

    parameters: name to (what counts, catalogue, derived, default).  Sources go into the map parameter_sources; a
    parameter that has no value at all is not in it.
    """
    sources, values = [], {}
    null = F.lit(None).cast("double")
    for name, (kind, catalogue, derived, default) in parameters.items():
        own, listed, made = (COUNTS[kind](null if c is None else c.cast("double")) for c in (F.col(name) if name in df.columns else None, catalogue, derived))
        values[name] = F.coalesce(own, listed, made, F.lit(default).cast("double"))
        source = F.when(own.isNotNull() | listed.isNotNull(), "measured").when(made.isNotNull(), "derived")
        sources.append(F.struct(F.lit(name).alias("key"), (source if default is None else source.otherwise("default")).alias("value")))
    held = F.map_from_entries(F.filter(F.array(*sources), lambda x: x["value"].isNotNull()))
    return df.withColumns(values | {"parameter_sources": held})


def prepared(samples: DataFrame, frozen: DataFrame, towers: DataFrame, conductor: Conductor, catalogue: dict[str, float]) -> DataFrame:
    """Inclination samples ready for ``validate``: matched with the snapshot, every parameter resolved, formulas applied.

    samples: tower_id, timestamp or sample_index, angle_deg, and any parameter that was measured with it;
    towers: line_id, tower_id, lon, lat of all towers of the snapshot; catalogue: values of the conductor's type.  A sample
    without a match is not calculated.  The theoretical temperature is the one that the current the line carried gives
    under the weather of that time, and the reference temperature where no such current is known.
    """
    length = spans(towers).where("span_source = 'derived'").select("tower_id", F.col("span_m").alias("_span"))
    df = match_snapshot(samples, frozen).join(length, "tower_id", "left")
    c, listed = F.col, {k: F.lit(float(v)) for k, v in catalogue.items() if not isinstance(v, tuple)}
    null = F.lit(None).cast("double")
    own = lambda x: c(x) if x in df.columns else null
    matched = c("snapshot_temp_c").isNotNull()
    masses = F.array(*[F.struct(F.lit(m).alias("mass")) for _, m in catalogue.get("materials", ())]) if catalogue.get("materials") else F.array().cast("array<struct<mass:double>>")
    weight, weight_source = unit_weight(own("unit_weight_n_m"), own("mass_per_length_kg_m"), listed.get("mass_per_length_kg_m", null), masses)
    wind = F.coalesce(COUNTS["nonnegative"](own("wind_speed")), c("snapshot_wind"), F.lit(0.0))
    df = df.withColumn("_given", COUNTS["nonnegative"](own("original_current_a")))
    first = {"span_m": ("positive", None, c("_span"), SAG["span_m"])}
    first |= {x: (kind, listed.get(x), None, SAG[x]) for x, kind in (("reference_tension_n", "positive"), ("reference_temp_c", "finite"), ("elastic_modulus_pa", "positive"), ("area_m2", "positive"), ("thermal_expansion_per_c", "positive"))}
    first |= {"ambient_temp_c": ("finite", None, c("snapshot_temp_c"), None), "original_current_a": ("nonnegative", None, c("snapshot_current_a"), None), "operating_current_a": ("nonnegative", None, c("carried_current_a"), None)}
    df = resolved(df.withColumns({"unit_weight_n_m": weight, "_weight": weight_source, "wind_speed": wind}), first).withColumnRenamed("parameter_sources", "_first")
    df = df.withColumns({"_solved": F.when(matched, solved_temperature(conductor, c("operating_current_a"))), "_again": F.when(matched, recalculated(conductor))})
    solved, again = COUNTS["finite"](c("_solved")), COUNTS["nonnegative"](c("_again"))
    df = df.withColumns({"theoretical_temp_c": F.when(matched, F.coalesce(solved, c("reference_temp_c"))), "recalculated_current_a": F.when(matched, F.coalesce(again, c("original_current_a")))})
    sources = F.map_concat("_first", F.create_map(F.lit("unit_weight_n_m"), c("_weight"), F.lit("theoretical_temp_c"), F.when(solved.isNotNull(), "derived").otherwise("default"), F.lit("recalculated_current_a"), F.when(again.isNotNull(), "derived").otherwise("default")))
    df = df.withColumns({"parameter_sources": F.when(matched, sources), "original_current_a": F.when(matched, c("original_current_a")), "ambient_temp_c": F.when(matched, c("ambient_temp_c"))})
    # an invalid row still shows the current that it came with
    made = measured(df).withColumn("original_current_a", F.coalesce("original_current_a", "_given"))
    return made.drop("_span", "_weight", "_first", "_solved", "_again", "_given")


def match_snapshot(samples: DataFrame, frozen: DataFrame) -> DataFrame:
    """A sample meets its tower's snapshot at its own time where it has one (a time outside
    the snapshot meets nothing), else by its index in the axis."""
    frozen = frozen.drop("lon", "lat")
    timed = samples.where("timestamp is not null").join(frozen.drop("line_id", "position"), ["tower_id", "timestamp"], "left")
    by_index = frozen.drop("line_id").withColumnRenamed("position", "sample_index")
    untimed = samples.where("timestamp is null").drop("timestamp").join(by_index, ["tower_id", "sample_index"], "left")
    return timed.unionByName(untimed, allowMissingColumns=True)


def tension(angle: Column, span: Column, weight: Column) -> Column:
    """Null for a level reading, which has no finite tension."""
    return weight * span / F.nullif(2.0 * F.tan(F.radians(angle)), F.lit(0.0))


def inferred_temperature(h: Column, h1: Column, t1: Column, modulus: Column, area: Column, expansion: Column) -> Column:
    return t1 + (h1 - h) / (modulus * area * expansion)


def derating(ambient: Column, theoretical: Column, measured: Column) -> Column:
    """Null where the temperatures allow none."""
    share = (theoretical - ambient) / F.nullif(measured - ambient, F.lit(0.0))
    return F.when((measured > ambient) & (theoretical >= ambient), F.sqrt(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))))


def measured(df: DataFrame) -> DataFrame:
    """Adds tension, inferred temperature, error and error_code (null for a valid row).

    A row that lacks a parameter or whose result is not finite is not calculated; the angle is looked at first, the
    temperatures last."""
    c = F.col
    df = df.withColumn("horizontal_tension_n", tension(c("angle_deg"), c("span_m"), c("unit_weight_n_m")))
    df = df.withColumn("measured_temp_c", inferred_temperature(c("horizontal_tension_n"), c("reference_tension_n"), c("reference_temp_c"), c("elastic_modulus_pa"), c("area_m2"), c("thermal_expansion_per_c")))
    good = c("angle_deg").between(SAG["min_angle_deg"], SAG["max_angle_deg"])
    known = reduce(lambda a, b: a & b, [finite(c(x)) for x in ("theoretical_temp_c", "ambient_temp_c", "measured_temp_c")] + [c("original_current_a").between(0.0, 1e300)])
    physical = reduce(lambda a, b: a & b, [(c(x) > -273.15) & (c(x) <= 1000.0) for x in ("theoretical_temp_c", "ambient_temp_c", "measured_temp_c")])
    code = F.when(~F.coalesce(good, F.lit(False)), "invalid_angle").when(~F.coalesce(known, F.lit(False)), "calculation_failed:ValueError").when(~physical, "nonphysical_temperature")
    return df.withColumns({"error_code": code, "temperature_error_c": c("measured_temp_c") - c("theoretical_temp_c")})


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _balance(conductor: Conductor, surface: Column) -> dict[str, Column]:
    """The heat balance under the weather of a matched sample."""
    return physics.heat_balance(conductor, surface, F.col("ambient_temp_c"), F.col("wind_speed"), F.col("wind_angle_deg"), F.col("elevation"), F.col("solar_radiation"))


def recalculated(conductor: Conductor) -> Column:
    """The current that the snapshot's weather allows at the highest temperature, unfactored:
    the default for a recalculated current."""
    return _balance(conductor, F.lit(conductor.max_temp))["current_a"]


#: Where a conductor's temperature is looked for at most, the first bound, and halvings of the bracket (to under 1e-10 degrees).
HOTTEST_C, FIRST_C, HALVINGS = 1004.0, 200.0, 46


def residual(conductor: Conductor, surface: Column, current: Column) -> Column:
    """W/m by which a current and the sun heat more than the air takes away at this temperature."""
    parts = _balance(conductor, surface)
    return current * current * parts["resistance"] + parts["q_solar"] - parts["q_convection"] - parts["q_radiation"]


def solved_temperature(conductor: Conductor, current: Column) -> Column:
    """The temperature that the conductor takes under a current: null without weather or current,
    or where none up to HOTTEST_C holds it.

    A bisection of fixed length as a fold over a sequence, on the columns of a matched sample; no row leaves Spark's
    engine.
    """
    def solved(first: Column) -> Column:
        top = F.when(residual(conductor, first, current) <= 0.0, first).when(residual(conductor, F.lit(HOTTEST_C), current) <= 0.0, HOTTEST_C)
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.col("ambient_temp_c").alias("low"), top.alias("high")), halved, lambda b: (b["low"] + b["high"]) / 2.0)

    def halved(bracket: Column, _: Column) -> Column:
        return let((bracket["low"] + bracket["high"]) / 2.0, lambda mid: let(residual(conductor, mid, current) > 0.0, lambda hotter: F.struct(F.when(hotter, mid).otherwise(bracket["low"]).alias("low"), F.when(hotter, bracket["high"]).otherwise(mid).alias("high"))))

    first = F.least(F.greatest(F.lit(FIRST_C), F.col("ambient_temp_c") + 1.0), F.lit(HOTTEST_C))
    return F.when((current >= 0.0) & (F.col("ambient_temp_c") < HOTTEST_C), let(first, solved))


#: Parameters that a row of direct mode must have.
DIRECT_POSITIVE = ("span_m", "unit_weight_n_m", "reference_tension_n", "elastic_modulus_pa", "area_m2", "thermal_expansion_per_c")
DIRECT_FINITE = ("reference_temp_c", "ambient_temp_c", "theoretical_temp_c")


def direct(df: DataFrame) -> DataFrame:
    """Rows that bring all parameters themselves, ready for ``validate``.

    Lengths, weights, tensions and material values must be positive, temperatures finite, currents not negative; a row
    that breaks this is not calculated.  Without a recalculated current the original one counts; without wind it is calm.
    """
    c = F.col
    if "recalculated_current_a" not in df.columns:
        df = df.withColumn("recalculated_current_a", c("original_current_a"))
    good = {x: (c(x) > 0.0) & finite(c(x)) for x in DIRECT_POSITIVE} | {x: finite(c(x)) for x in DIRECT_FINITE}
    good |= {x: (c(x) >= 0.0) & finite(c(x)) for x in ("original_current_a", "recalculated_current_a")}
    whole = reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(False)) for x in good.values()])
    wind = F.when(c("wind_speed").between(0.0, 1e300), c("wind_speed")) if "wind_speed" in df.columns else F.lit(None).cast("double")
    original = F.when(good["original_current_a"], c("original_current_a"))
    held = {x: F.when(whole, c(x)) for x in good}
    sources = F.when(whole, F.create_map(*[F.lit(y) for x in good for y in (x, "measured")]))
    made = measured(df.withColumns(held | {"wind_speed": F.coalesce(wind, F.lit(0.0)), "parameter_sources": sources, "given_current_a": original}))
    # an invalid row still shows the current that it came with
    return made.withColumn("original_current_a", F.coalesce("original_current_a", "given_current_a")).drop("given_current_a")


# ------------------------------------------------------------------ the machine of one tower


@dataclass
class Memory:
    """What a tower keeps between samples."""

    state: str = "NORMAL"
    last: float | None = None
    calm: int = 0  #: samples in a row that allow a recovery
    angles: list[float] = field(default_factory=list)
    winds: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)  #: absolute


def _mad(values: list[float]) -> float:
    kept = np.array([v for v in values if v is not None and math.isfinite(v)])
    return float(np.median(np.abs(kept - np.median(kept)))) if len(kept) >= 2 else 0.0


def threshold(m: Memory, angle: float, wind: float, span: float) -> float:
    """Base plus the unrest of angle and wind (past valid samples and this one), the excess of
    the span, and the median of past errors."""
    past = m.errors
    return SAG["base_threshold_c"] + 2.0 * _mad([*m.angles, angle]) + 0.25 * _mad([*m.winds, wind]) + max(0.0, span / SAG["span_m"] - 1.0) + 0.25 * (float(np.median(past)) if past else 0.0)


def step(m: Memory, row: dict) -> dict:
    """One sample through the machine; changes the memory unless the sample is invalid."""

    def out(state: str, code: str | None, limit: float, factor: float, checked: float, final: float) -> dict:
        return {"state": state, "error_code": code, "threshold_c": limit, "derating_factor": factor, "checked_current_a": checked, "final_current_a": final}

    def invalid(code: str) -> dict:
        original = row["original_current_a"]
        original = 0.0 if original is None or not math.isfinite(original) else original
        held = m.last if m.last is not None else original
        return out("INVALID", code, SAG["base_threshold_c"], 1.0, held, held)

    if row["error_code"]:
        return invalid(row["error_code"])
    original, error, wind = row["original_current_a"], row["temperature_error_c"], row["wind_speed"]
    limit = threshold(m, row["angle_deg"], wind, row["span_m"])
    held = m.last if m.last is not None else original
    toward = SAG["recovery_alpha"] * original + (1 - SAG["recovery_alpha"]) * held
    calm = error < limit * SAG["recovery_ratio"]
    factor, checked, count = 1.0, original, 0
    if row["measured_temp_c"] > row["theoretical_temp_c"] and error > limit:
        room = row["measured_temp_c"] - row["ambient_temp_c"]
        share = row["theoretical_temp_c"] - row["ambient_temp_c"]
        if room <= 0 or share < 0:
            return invalid("derating_failed:ValueError")
        factor = math.sqrt(min(max(share / room, 0.0), 1.0))
        checked = min(original, row["recalculated_current_a"], factor * original)
        state, final = "RISK", checked
    elif m.state == "RISK":
        count = m.calm + 1 if calm else 0
        state, final = ("RECOVERY", toward) if count >= SAG["recovery_samples"] else ("RISK", held)
    elif m.state == "RECOVERY":
        count = m.calm
        state, final = ("RECOVERY", toward) if calm else ("RECOVERY", held)
        if calm and abs(original - toward) < SAG["convergence_a"]:
            state, final, count = "NORMAL", original, 0
    else:
        state, final = "NORMAL", original
    if not all(map(math.isfinite, (factor, checked, final))):
        return invalid("non_finite_output")
    m.state, m.last, m.calm = state, final, count
    for kept, value in ((m.angles, row["angle_deg"]), (m.winds, wind), (m.errors, abs(error))):
        kept.append(value)
        del kept[: -SAG["history"]]
    return out(state, None, limit, factor, checked, final)


STEP_COLUMNS = "state string, error_code string, threshold_c double, derating_factor double, checked_current_a double, final_current_a double"
INPUTS = ("angle_deg", "measured_temp_c", "theoretical_temp_c", "ambient_temp_c", "temperature_error_c", "wind_speed", "span_m", "original_current_a", "recalculated_current_a", "error_code")
MEMORY = "state string, last double, calm int, angles array<double>, winds array<double>, errors array<double>"


def _median(values: Column) -> Column:
    """Of an array that has an element at least."""
    n = F.size(values)
    return let(F.array_sort(values), lambda s: (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2.0)


def _spread(values: Column) -> Column:
    """Median absolute deviation; 0 for fewer than two values."""
    return F.when(F.size(values) < 2, 0.0).otherwise(let(_median(values), lambda m: _median(F.transform(values, lambda x: F.abs(x - m)))))


def limit_of(memory: Column, row: Column) -> Column:
    """``threshold`` as a column, out of a tower's memory and its next row."""
    past = F.when(F.size(memory["errors"]) > 0, _median(memory["errors"])).otherwise(0.0)
    unrest = 2.0 * _spread(F.concat(memory["angles"], F.array(row["angle_deg"]))) + 0.25 * _spread(F.concat(memory["winds"], F.array(row["wind_speed"])))
    return SAG["base_threshold_c"] + unrest + F.greatest(F.lit(0.0), row["span_m"] / SAG["span_m"] - 1.0) + 0.25 * past


def _next(memory: Column, row: Column) -> Column:
    """``step`` as a column: a tower's memory after one more row, and what the row gives."""
    limit = F.when(row["error_code"].isNull(), limit_of(memory, row)).otherwise(SAG["base_threshold_c"])
    return let(F.struct(memory.alias("m"), row.alias("row"), limit.alias("limit")), _judged)


def _judged(x: Column) -> Column:
    m, row, limit = x["m"], x["row"], x["limit"]
    original, error = row["original_current_a"], row["temperature_error_c"]
    held = F.coalesce(m["last"], original)
    toward = SAG["recovery_alpha"] * original + (1 - SAG["recovery_alpha"]) * held
    calm = error < limit * SAG["recovery_ratio"]
    risk = (row["measured_temp_c"] > row["theoretical_temp_c"]) & (error > limit)
    at_risk, healing = m["state"] == "RISK", m["state"] == "RECOVERY"
    count = F.when(risk, 0).when(at_risk, F.when(calm, m["calm"] + 1).otherwise(0)).when(healing, m["calm"]).otherwise(0)
    enough = count >= SAG["recovery_samples"]
    back = calm & (F.abs(original - toward) < SAG["convergence_a"])
    room, share = row["measured_temp_c"] - row["ambient_temp_c"], row["theoretical_temp_c"] - row["ambient_temp_c"]
    factor = F.when(risk, derating(row["ambient_temp_c"], row["theoretical_temp_c"], row["measured_temp_c"])).otherwise(1.0)
    checked = F.when(risk, F.least(original, row["recalculated_current_a"], factor * original)).otherwise(original)
    state = F.when(risk, "RISK").when(at_risk, F.when(enough, "RECOVERY").otherwise("RISK")).when(healing, F.when(back, "NORMAL").otherwise("RECOVERY")).otherwise("NORMAL")
    final = F.when(risk, checked).when(at_risk, F.when(enough, toward).otherwise(held)).when(healing, F.when(back, original).when(calm, toward).otherwise(held)).otherwise(original)
    code = F.coalesce(row["error_code"], F.when(risk & ((room <= 0.0) | (share < 0.0)), "derating_failed:ValueError"), F.when(~(finite(factor) & finite(checked) & finite(final)), "non_finite_output"))
    count = F.when(healing & back & ~risk, 0).otherwise(count)
    seen = F.struct(m.alias("m"), row.alias("row"), limit.alias("limit"), code.alias("code"), state.alias("state"), final.alias("final"), factor.alias("factor"), checked.alias("checked"), count.cast("int").alias("count"))
    return let(seen, _remembered)


def _remembered(x: Column) -> Column:
    m, row, code = x["m"], x["row"], x["code"]
    ok = code.isNull()
    keep = lambda old, value: F.when(F.size(old) < SAG["history"], F.concat(old, F.array(value))).otherwise(F.concat(F.slice(old, 2, SAG["history"] - 1), F.array(value)))
    after = F.struct(x["state"].alias("state"), x["final"].alias("last"), x["count"].alias("calm"), keep(m["angles"], row["angle_deg"]).alias("angles"), keep(m["winds"], row["wind_speed"]).alias("winds"), keep(m["errors"], F.abs(row["temperature_error_c"])).alias("errors"))
    given = F.when(finite(row["original_current_a"]), row["original_current_a"]).otherwise(0.0)
    held = F.coalesce(m["last"], given)
    pick = lambda good, bad: F.when(ok, good).otherwise(bad)
    made = F.struct(row["i"].alias("i"), pick(x["state"], F.lit("INVALID")).alias("state"), code.alias("error_code"), pick(x["limit"], F.lit(SAG["base_threshold_c"])).alias("threshold_c"), pick(x["factor"], F.lit(1.0)).alias("derating_factor"), pick(x["checked"], held).alias("checked_current_a"), pick(x["final"], held).alias("final_current_a"))
    return F.struct(pick(after, m).alias("memory"), made.alias("made"))


def folded(prepared: DataFrame, order: str = "sample_index", samples: int = ROWS, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, memories): the state machine of every tower in input order, and what every tower remembers at the end.

    Which samples count for a threshold depends on the thresholds before, so a tower's samples are a chain: see
    ``chains.fold``, which takes ``samples`` of a tower at once.  start: memories of an earlier run.
    """
    rows = prepared.select("tower_id", F.col(order).alias("i"), *[F.coalesce(c, F.lit(0.0)).alias(c) if c == "wind_speed" else F.col(c) for c in INPUTS])
    fresh = F.from_json(F.lit('{"state": "NORMAL", "calm": 0, "angles": [], "winds": [], "errors": []}'), MEMORY)
    made = f"struct<i: {dict(rows.dtypes)['i']}, " + ", ".join(": ".join(c.split(" ")) for c in STEP_COLUMNS.split(", ")) + ">"
    fields = [c.split(" ")[0] for c in MEMORY.split(", ")]
    before = None if start is None else start.select("tower_id", F.struct(*fields).alias("memory"))
    states, memories = fold(rows, ["tower_id"], ["i"], before, fresh, _next, made, samples)
    return states.withColumnRenamed("i", order), memories.select("tower_id", "memory.*")


def validate(prepared: DataFrame, order: str = "sample_index", samples: int = ROWS) -> DataFrame:
    """The states of ``folded``."""
    return folded(prepared, order, samples)[0]


def summary(states: DataFrame) -> DataFrame:
    """Rows by state and error code, and in total."""
    return states.groupBy("state", F.coalesce("error_code", F.lit("none")).alias("error_code")).agg(F.count("*").alias("rows"))


def source_counts(prepared: DataFrame) -> DataFrame:
    return prepared.select(F.explode("parameter_sources").alias("parameter", "source")).groupBy("parameter", "source").agg(F.count("*").alias("rows"))


#: Fixed labels of the table that is shown.
LABELS = {"tower_id": "杆塔", "timestamp": "时间", "state": "状态", "angle_deg": "倾角(°)", "measured_temp_c": "反演温度(°C)", "theoretical_temp_c": "理论温度(°C)", "original_current_a": "原始载流量(A)", "final_current_a": "最终载流量(A)"}


def tower_label(prepared: DataFrame) -> DataFrame:
    """One row: the tower of a run, ``multiple`` or ``none``, with the numbers of towers and rows."""
    n = F.countDistinct("tower_id")
    return prepared.agg(F.when(n == 0, "none").when(n == 1, F.min("tower_id")).otherwise("multiple").alias("tower"), n.alias("towers"), F.count("*").alias("rows"))


def payload(states: DataFrame) -> DataFrame:
    """A JSON document for each result."""
    return states.select("tower_id", F.to_json(F.struct(*states.columns)).alias("document"))


def visible(states: DataFrame) -> DataFrame:
    return states.select(*[F.col(c).alias(label) for c, label in LABELS.items()])
