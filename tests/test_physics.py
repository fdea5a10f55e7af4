"""Published numbers of the standard's example and of the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwatt.config import Conductor, Correction
from spanwatt.functions import physics
from spanwatt.operators import correction, sag, terrain, transient

DRAKE = Conductor(0.02814, 7.283e-5, 8.688e-5, 1.220e-4, (("aluminum", 1.116), ("steel", 0.5126)), 0.8, 0.8, 100.0)


def value(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_drake(spark):
    lit = F.lit
    parts = physics.heat_balance(DRAKE, lit(100.0), lit(40.0), lit(0.61), lit(90.0), lit(0.0), lit(0.0))
    sun = physics.clear_sky_gain(DRAKE, lit(30.0), lit(161.0), lit(11.0), lit(0.0), lit(90.0))
    r = value(spark, **parts, sun=sun)
    assert r.q_natural == pytest.approx(42.42, abs=0.15) and r.q_low == pytest.approx(82.10, abs=0.2) and r.q_high == pytest.approx(77.06, abs=0.2)
    assert r.q_radiation == pytest.approx(39.11, abs=0.15) and r.sun == pytest.approx(22.45, abs=0.25) and r.resistance == pytest.approx(9.391e-5, rel=2e-3)
    assert math.sqrt((r.q_convection + r.q_radiation - r.sun) / r.resistance) == pytest.approx(1025, abs=2)


def test_formulas(spark):
    lit = F.lit
    factors = value(spark, **{f"a{k}": physics.wind_angle_factor(lit(float(v))) for k, v in enumerate((0, 90, 180, -90, 270))})
    assert list(factors) == pytest.approx([0.388, 1, 0.388, 1, 1], abs=1e-12)
    r = value(spark, am=physics.solar_azimuth(lit(30.0), lit(161.0), lit(11.0)), pm=physics.solar_azimuth(lit(30.0), lit(161.0), lit(13.0)), ohm=physics.resistance(Conductor(0.02, 1.0, 2.0, 10.0), lit(150.0)))
    assert (r.am, r.pm, r.ohm) == pytest.approx((113.98441942855138, 246.01558057144862, 7.428571428571429))
    h = value(spark, t=sag.tension(lit(45.0), lit(100.0), lit(10.0)), k=sag.derating(lit(20.0), lit(60.0), lit(80.0)), level=sag.tension(lit(0.0), lit(100.0), lit(10.0)), m=sag.inferred_temperature(lit(500.0), lit(1000.0), lit(20.0), lit(1e11), lit(1e-4), lit(1e-5)))
    assert h.t == pytest.approx(500) and h.k == pytest.approx(math.sqrt(2 / 3)) and h.level is None and h.m == pytest.approx(25)
    calm = value(spark, **physics.convection(DRAKE, lit(80.0), lit(20.0), lit(0.0), lit(90.0), lit(0.0)))
    assert calm.q_low == calm.q_high == 0 and calm.q_convection == calm.q_natural > 0
    unknown = value(spark, **physics.heat_balance(DRAKE, lit(80.0), lit(None).cast("double"), lit(1.0), lit(90.0), lit(0.0), lit(0.0)))
    assert unknown.current_a is None
    assert DRAKE.heat_capacity == pytest.approx(1310, abs=0.5)


WEATHER = tuple(np.array([v]) for v in (40.0, 0.61, 90.0, 0.0, 22.45 / 0.8 / 0.02814))


def test_transient():
    now = transient.steady(DRAKE, np.array([800.0]), *WEATHER)
    assert abs(transient.net_loss(DRAKE, now, *WEATHER) - 800.0**2 * transient.ohms(DRAKE, now)) < 1e-3
    assert transient.steady(DRAKE, np.array([1025.0]), *WEATHER)[0] == pytest.approx(100, abs=0.3)
    start = transient.steady(DRAKE, np.array([1025.0]), *WEATHER)
    whole = transient.advance(DRAKE, start, np.array([1200.0]), 25.0, *WEATHER)
    parts = start
    for s in (10.0, 10.0, 5.0):
        parts = transient.advance(DRAKE, parts, np.array([1200.0]), s, *WEATHER)
    assert whole == pytest.approx(parts, abs=1e-12)
    assert transient.advance(DRAKE, np.array([100.0]), np.array([1312.0]), 900.0, *WEATHER)[0] == pytest.approx(125, abs=0.3)
    hot = transient.time_to_limit(DRAKE, np.array([100.0, 126.0, 100.0]), np.array([1312.0, 1312.0, 500.0]), 125.0, *[np.repeat(w, 3) for w in WEATHER])
    assert hot[0] == pytest.approx(900, abs=15) and hot[1] == 0 and np.isinf(hot[2])
    times = np.arange(0.0, 7201.0, 1800.0)
    series = [np.repeat(w[:, None], len(times), 1) for w in WEATHER]
    got = transient.window_rating(DRAKE, times, series, 0.0, 7200.0, np.array([600.0]))
    top = transient.steady(DRAKE, got, *WEATHER)
    assert 1020 < got[0] < 1040 and top[0] == pytest.approx(100, abs=0.1)
    assert transient.window_rating(DRAKE, times, series, 9000.0, 9900.0, np.array([600.0]))[0] == 0


def test_correction(spark):
    rows = spark.createDataFrame([("a", 10.0, 20.0, 500.0, 180.0, 10.0, 180.0), ("b", 10.0, 20.0, 500.0, 0.0, 10.0, 180.0), ("c", 10.0, 20.0, 500.0, 90.0, 1.0, 180.0)], "tower_id string, wind_speed double, ambient_temp double, solar_radiation double, wind_direction double, slope double, aspect double")
    got = {r.tower_id: r for r in correction.correct(rows, Correction()).collect()}
    assert got["a"].terrain_wind_factor == pytest.approx(1 - 10 / 45 * 0.4) and got["b"].terrain_wind_factor == pytest.approx(1 + 10 / 45 * 0.4) and got["c"].terrain_wind_factor == 1
    assert got["c"].wind_speed_local == pytest.approx(10 * 2**0.15) and got["c"].ambient_temp_local == pytest.approx(20 - 0.065)
    assert (got["a"].wind_angle_deg, got["c"].wind_angle_deg) == (90.0, 0.0)
    assert {r.wind_angle_deg for r in correction.correct(rows, Correction(direction=False)).collect()} == {90.0}
    with pytest.raises(Exception, match="corrected already"):
        correction.correct(correction.correct(rows)).collect()
    with pytest.raises(Exception, match="wind_speed_out_of_bounds"):
        correction.correct(rows.withColumn("wind_speed", F.lit(99.0)), checked=True).collect()


def test_terrain(spark):
    import itertools

    cell = 1e-4
    metres = 2 * math.pi * 6378137 / 360 * cell  # at the equator
    cells = [(r, c, 10.0 * c * metres / 10, False) for r, c in itertools.product(range(3), range(3))]
    dem = spark.createDataFrame(cells, "row long, col long, elevation double, masked boolean")
    towers = spark.createDataFrame([("1", 1.5 * cell, -1.5 * cell), ("2", 9.0, 9.0), ("3", None, None)], "tower_id string, lon double, lat double")
    got = {r.tower_id: r for r in terrain.sample(towers, dem, terrain.Affine(0.0, 0.0, cell, cell)).collect()}
    assert got["1"].slope == pytest.approx(45, abs=0.2) and got["1"].aspect == pytest.approx(270, abs=0.2)
    assert (got["2"].slope, got["2"].terrain_elevation, got["2"].terrain_source) == (0.0, 1000.0, "default")
    assert got["3"].terrain_reason == "missing_coordinates"
