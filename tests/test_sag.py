"""The sag check: temperatures from currents, the machine as a fold, direct mode, the snapshot."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanwatt.config import CONDUCTORS, Conductor
from spanwatt.operators import sag

INPUT = "tower_id string, sample_index long, angle_deg double, measured_temp_c double, theoretical_temp_c double, ambient_temp_c double, temperature_error_c double, wind_speed double, span_m double, original_current_a double, recalculated_current_a double, error_code string"


def random_rows(towers: int, each: int, seed: int = 5) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for t in range(towers):
        for i in range(each):
            theoretical, ambient = rng.choice([15.0, 30.0, 60.0]), rng.uniform(0, 40)
            error = rng.choice([rng.uniform(-20, 4), rng.uniform(-3, 3), rng.uniform(5, 40)])
            code = "invalid_angle" if rng.random() < 0.1 else None
            rows.append((f"{t:03}", i, None if code else rng.uniform(5, 12), theoretical + error, theoretical, ambient, error, rng.uniform(0, 9), rng.choice([250.0, 300.0, 450.0]), rng.uniform(600, 1100), rng.uniform(500, 1100), code))
    return rows


def test_fold_is_the_machine(spark):
    """Row by row in Python, in one fold, and in folds of 7 samples that hand on their memory."""
    rows = random_rows(6, 60)
    names = [c.split(" ")[0] for c in INPUT.split(", ")]
    want, memory = {}, {}
    for r in rows:
        row = dict(zip(names, r, strict=True))
        want[row["tower_id"], row["sample_index"]] = sag.step(memory.setdefault(row["tower_id"], sag.Memory()), row)
    assert {x["state"] for x in want.values()} == {"NORMAL", "RISK", "RECOVERY", "INVALID"} and any(x["error_code"] == "derating_failed:ValueError" for x in want.values())
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), INPUT)
    for samples in (512, 7):
        got = sag.validate(df, samples=samples).collect()
        assert len(got) == len(rows)
        for r in got:
            x = want[r.tower_id, r.sample_index]
            assert (r.state, r.error_code) == (x["state"], x["error_code"])
            assert [r.threshold_c, r.derating_factor, r.checked_current_a, r.final_current_a] == pytest.approx([x["threshold_c"], x["derating_factor"], x["checked_current_a"], x["final_current_a"]], rel=1e-9)


def test_fold_of_nothing(spark):
    assert sag.validate(spark.createDataFrame([], INPUT)).count() == 0


DRAKE = Conductor(0.02814, 7.283e-5, 8.688e-5, 1.220e-4)


def test_solved_temperature(spark):
    """The example of the standard takes 100 degrees at its rating; without current or weather there is none."""
    rows = [(40.0, 0.61, 90.0, 0.0, 1000.0, 1025.0), (40.0, 0.61, 90.0, 0.0, 1000.0, 0.0), (40.0, 0.61, 90.0, 0.0, 0.0, 60000.0), (40.0, 0.61, 90.0, 0.0, 1000.0, None), (None, None, None, None, None, 500.0), (20.0, 0.0, 0.0, 500.0, 0.0, 1500.0)]
    df = spark.createDataFrame(rows, "ambient_temp_c double, wind_speed double, wind_angle_deg double, elevation double, solar_radiation double, amps double")
    df = df.withColumn("t", sag.solved_temperature(DRAKE, F.col("amps"))).withColumn("left", sag.residual(DRAKE, F.col("t"), F.col("amps")))
    got = df.collect()
    assert got[0].t == pytest.approx(100, abs=1.0) and got[1].t > 40 and got[2].t is None and got[3].t is None and got[4].t is None
    assert all(abs(r.left) <= 1e-6 for r in got if r.t is not None)


def test_direct_mode(spark):
    """All parameters come from the row; what is missing or out of range is named, in a fixed order."""
    base = {"tower_id": "001", "sample_index": 0, "angle_deg": math.degrees(math.atan(0.5)), "span_m": 100.0, "unit_weight_n_m": 10.0, "reference_tension_n": 1000.0, "reference_temp_c": 20.0, "elastic_modulus_pa": 1e11, "area_m2": 1e-4, "thermal_expansion_per_c": 1e-5, "ambient_temp_c": 0.0, "theoretical_temp_c": 15.0, "original_current_a": 1000.0, "wind_speed": 3.0}
    changes = [{}, {"span_m": 0.0}, {"area_m2": None}, {"theoretical_temp_c": 1001.0}, {"original_current_a": -1.0}, {"angle_deg": 0.0, "span_m": None}, {"ambient_temp_c": float("inf")}]
    rows = [base | {"sample_index": k} | x for k, x in enumerate(changes)]
    schema = "tower_id string, sample_index long, " + ", ".join(f"{c} double" for c in base if c not in ("tower_id", "sample_index"))
    made = {r.sample_index: r for r in sag.direct(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()}
    assert made[0].error_code is None and made[0].horizontal_tension_n == pytest.approx(1000) and made[0].measured_temp_c == pytest.approx(20) and made[0].recalculated_current_a == 1000
    assert set(made[0].parameter_sources.values()) == {"measured"}
    failed = "calculation_failed:ValueError"
    assert [made[k].error_code for k in range(1, 7)] == [failed, failed, "nonphysical_temperature", failed, "invalid_angle", failed]
    assert made[1].original_current_a == 1000 and made[4].original_current_a is None


def weather(spark, rows):
    schema = "line_id string, tower_id string, timestamp timestamp_ntz, rating_a double, ambient_temp_local double, wind_speed_local double, wind_angle_deg double, solar_radiation_local double, rated_elevation double, actual_currents double"
    return spark.createDataFrame(rows, schema)


def test_prepared(spark):
    """A carried current gives the theoretical temperature, the row's own current goes before the snapshot's; without one
    the reference temperature counts.  Samples without a match are not calculated; spans come from the next tower."""
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    rows = [("l", t, x, 800.0, 25.0, 2.0, 60.0, 300.0, 100.0, 600.0 if h == 1 else -5.0) for t in ("001", "002") for h, x in enumerate(at)]
    places = spark.createDataFrame([("001", 120.0, 40.0), ("002", 120.0035, 40.0)], "tower_id string, lon double, lat double")
    frozen = sag.snapshot(weather(spark, rows), places, checked=True)
    samples = spark.createDataFrame(
        [("001", at[0], 0, 8.0, None, None), ("001", at[1], 1, 8.0, None, None), ("001", at[1], 2, 8.0, 900.0, 250.0), ("002", None, 1, 8.0, None, None), ("002", dt.datetime(2030, 1, 1), 1, 8.0, None, -3.0), ("003", at[0], 0, 8.0, None, None)],
        "tower_id string, timestamp timestamp_ntz, sample_index long, angle_deg double, operating_current_a double, span_m double",
    )
    towers = places.withColumn("line_id", F.lit("l"))
    wire = CONDUCTORS["4×JL/G1A-630/45"]
    made = sag.prepared(samples, frozen, towers, DRAKE, {k: wire[k] for k in ("area_m2", "materials")}).collect()
    got = {(r.tower_id, r.timestamp, r.sample_index): r for r in made}
    plain, carried, own, by_index = got["001", at[0], 0], got["001", at[1], 1], got["001", at[1], 2], got["002", at[1], 1]
    assert plain.theoretical_temp_c == 20.0 and plain.parameter_sources["theoretical_temp_c"] == "default" and "operating_current_a" not in plain.parameter_sources
    assert 25 < carried.theoretical_temp_c < own.theoretical_temp_c and carried.parameter_sources["operating_current_a"] == "derived" and own.parameter_sources["operating_current_a"] == "measured"
    assert own.span_m == 250.0 and plain.span_m == pytest.approx(298.1, abs=0.5) and plain.parameter_sources["span_m"] == "derived" and plain.parameter_sources["area_m2"] == "measured"
    assert by_index.theoretical_temp_c == pytest.approx(carried.theoretical_temp_c) and by_index.error_code is None
    assert [got[k].error_code for k in got if k[0] == "003" or k[1] == dt.datetime(2030, 1, 1)] == ["calculation_failed:ValueError"] * 2
    with pytest.raises(ValueError):
        sag.snapshot(weather(spark, rows + rows[:1]), places, checked=True)


def test_label(spark):
    df = spark.createDataFrame([("001",), ("001",)], "tower_id string")
    assert sag.tower_label(df).first().tower == "001" and sag.tower_label(df.where("false")).first().tower == "none"
    assert sag.tower_label(df.union(spark.createDataFrame([("2",)], "tower_id string"))).first().tower == "multiple"
