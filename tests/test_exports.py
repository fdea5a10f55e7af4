"""Guards that count as rows pass, matrices in blocks of time, and lookups of towers by doubtful names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanwatt.config import Conductor, Correction
from spanwatt.operators import guards, matrices, ratings, terrain

T0 = dt.datetime(2024, 1, 1)
WIRE = Conductor(0.0281, 7.283e-5, 8.688e-5, 1.220e-4)


def at(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


def test_guard(spark):
    schema = "id int, ambient_temp_local double, wind_speed_local double, wind_angle_deg double, solar_radiation_local double, elevation double"
    rows = [(0, 20.0, 1.0, 90.0, 0.0, 0.0), (1, 81.0, -1.0, 90.0, 0.0, 0.0), (2, -273.15, 1.0, None, 0.0, 0.0), (3, float("nan"), 1.0, 90.0, -1.0, 0.0), (4, 80.0, 0.0, 0.0, 0.0, float("inf"))]
    df = spark.createDataFrame(rows, schema)
    good, refused, counts = guards.divided(df, ratings.input_rules(WIRE))
    assert [r.id for r in good.collect()] == [0] and good.columns == df.columns
    got = {r.id: r.refusals for r in refused.collect()}
    assert got == {1: ["above_max_temp", "negative_wind"], 2: ["wind_angle_deg_not_finite", "below_absolute_zero"], 3: ["ambient_temp_local_not_finite", "above_max_temp", "negative_solar"], 4: ["elevation_not_finite"]}
    assert (counts["rows"], counts["refused"], counts["negative_wind"], counts["elevation_not_finite"]) == (5, 4, 1, 1)
    with pytest.raises(Exception, match="above_max_temp, negative_wind"):
        guards.required(df.where("id = 1"), ratings.input_rules(WIRE), "bad").collect()
    assert guards.divided(df.where("false"), ratings.input_rules(WIRE))[2]["rows"] == 0
    for bad in ({"diameter": 0.0}, {"emissivity": 1.5}, {"max_temp": -300.0}):
        with pytest.raises(ValueError):
            ratings.checked_conductor(Conductor(**({"diameter": 0.0281, "r25": 7e-5, "r75": 8e-5, "r200": 1e-4} | bad)))


def readings(spark, rows):
    return spark.createDataFrame([("l", *r) for r in rows], "line_id string, tower_id string, timestamp timestamp_ntz, v double")


def test_blocks(spark):
    """A day is a block, an array a tower; what a matrix lacks is named or fails the job."""
    full = [(t, at(12 * k), float(k)) for t in "ab" for k in range(4)]
    made = {(r.tower_id, r.block): (r.times, r.v) for r in matrices.blocks(readings(spark, full[::-1]), ["v"]).collect()}
    assert made == {(t, at(24 * d)): ([at(24 * d), at(24 * d + 12)], [2.0 * d, 2.0 * d + 1]) for t in "ab" for d in range(2)}
    problems = lambda rows: {(r.tower_id, r.block.day): r.problem for r in matrices.blocks(readings(spark, rows), ["v"], complete=False).collect()}
    assert problems(full + full[:1])["a", 1] == "duplicate"
    assert problems([*full[1:], ("a", at(0), None)])["a", 1] == problems([*full[1:], ("a", at(0), float("nan"))])["a", 1] == "not_finite"
    lacks = problems(full[1:])
    assert lacks["a", 1] == "missing_times" and lacks["b", 1] is None and lacks["a", 2] is None
    assert problems(full[:2] + full[4:]) == {("a", 1): None, ("b", 1): None, ("b", 2): "missing_towers"}
    with pytest.raises(Exception, match="missing_times at tower a"):
        matrices.blocks(readings(spark, full[1:]), ["v"]).collect()
    assert matrices.blocks(readings(spark, []), ["v"]).count() == 0


def test_long_axis(spark):
    """A million times of a tower are blocks of a day, none longer."""
    df = spark.range(200_000).select(F.lit("l").alias("line_id"), F.lit("a").alias("tower_id"), F.expr("timestampadd(MINUTE, id, timestamp_ntz'2024-01-01')").alias("timestamp"), F.col("id").cast("double").alias("v"))
    sizes = matrices.blocks(df, ["v"]).agg(F.max(F.size("v")).alias("most"), F.sum(F.size("v")).alias("all")).first()
    assert (sizes.most, sizes["all"]) == (1440, 200_000)


def test_corrected_blocks(spark):
    rows = [("l", t, at(k), 20.0 + 5 * i, 4.0, 90.0, 100.0 * (i + 1) + k) for i, t in enumerate("ab") for k in range(2)]
    df = spark.createDataFrame(rows, "line_id string, tower_id string, timestamp timestamp_ntz, ambient_temp double, wind_speed double, wind_direction double, solar_radiation double")
    made, axis = matrices.corrected_blocks(df, Correction(desert=True, ground_temp_offset=5.0))
    got = {r.tower_id: r for r in made.collect()}
    assert got["a"].wind_speed_local == pytest.approx([4 * 2**0.15] * 2) and got["a"].vertical_wind_factor == pytest.approx([2**0.15] * 2) and got["b"].ambient_temp_local == pytest.approx([24.935] * 2)
    solar = {r.timestamp: r for r in axis.collect()}
    assert solar[at(0)].solar_before == 150 and solar[at(1)].solar_before == 151 and solar[at(0)].solar_delta > 150 * 0.35 * 0.3


def test_tower_arrays(spark):
    schema = "tower_id string, timestamp timestamp_ntz, ambient_temp double, wind_speed double, wind_direction double, elevation double, solar_radiation double"
    rows = [("a", at(30), 2.0, 1.0, 0.0, 100.0, 10.0), ("a", at(1.5), 1.0, 1.0, 0.0, None, None), ("b", at(1.5), 3.0, 1.0, 0.0, 300.0, 20.0), ("b", at(2), None, 1.0, 0.0, 300.0, 20.0)]
    made, axis = matrices.tower_arrays(spark.createDataFrame(rows, schema))
    got = {(r.tower_id, r.block): r for r in made.collect()}
    assert got["a", at(0)].hour == [0.0] and got["a", at(24)].hour == [28.5] and got["a", at(0)].elevation == [200.0] and got["b", at(0)].ambient_temp == [3.0] and got["a", at(0)].humidity == [50.0]
    assert {(r.timestamp, r.solar_radiation) for r in axis.collect()} == {(at(1.5), 10.0), (at(30), 10.0)}
    day, _ = matrices.tower_arrays(spark.createDataFrame(rows[1:], schema))
    assert {r.tower_id: r.hour for r in day.collect()} == {"a": [1.5], "b": [1.5]}  # the clock's hours
    plot = matrices.slice_of(spark.createDataFrame(rows, schema), "a", spark.createDataFrame([(at(1.5),), (at(2),)], "timestamp timestamp_ntz"))
    assert [r.timestamp for r in plot.collect()] == [at(1.5)]


def test_requested_coordinates(spark):
    """A number is ambiguous if two ids have its value, one of them with two places included; texts match exactly."""
    raw = spark.createDataFrame([("T-007", 1.0, 1.0), ("T-7", 2.0, 2.0), ("T-12", 3.0, 3.0), ("T-012", 4.0, 4.0), ("T-012", 5.0, 5.0), ("T-15", 6.0, 6.0), ("T-20", 7.0, 7.0), ("T-20", 8.0, 7.0)], "label string, lon double, lat double")
    coords, known = terrain.tower_coordinates(raw), terrain.labelled_towers(raw)
    numbers = spark.createDataFrame([(7,), (12,), (15,), (20,), (99,)], "request long")
    assert [(r.request, r.tower_id) for r in terrain.requested_coordinates(coords, known, numbers).collect()] == [(15, "15")]
    assert [(r.request, r.tower_id) for r in terrain.requested_coordinates(coords, known, spark.createDataFrame([(15.0,), (15.5,), (-15.0,)], "request double")).collect()] == [(15.0, "15")]
    texts = spark.createDataFrame([("007",), ("7",), ("12号",), ("012",), ("15.0",), ("x",)], "request string")
    assert sorted((r.request, r.tower_id, r.lon) for r in terrain.requested_coordinates(coords, known, texts).collect()) == [("007", "007", 1.0), ("12号", "12", 3.0), ("15.0", "15", 6.0), ("7", "7", 2.0)]


def test_lookup(spark):
    coords = spark.createDataFrame([("7号", 100.005, 39.995), ("012", 100.005, 39.995), ("12", 50.0, 50.0), ("5", 100.005, 39.995)], "tower_id string, lon double, lat double")
    dem = spark.createDataFrame([(0, 0, 500.0, False)], "row long, col long, elevation double, masked boolean")
    grid = terrain.Affine(100.0, 40.0, 0.01, 0.01)
    texts = spark.createDataFrame([("7",), ("012号",), ("12",), ("99",)], "position string")
    got = {r.position: (r.tower_id, r.terrain_elevation, r.terrain_reason) for r in terrain.lookup(texts, coords, dem, grid).collect()}
    assert got == {"7": ("7", 500.0, None), "012号": ("012", 500.0, None), "12": ("12", 1000.0, "nodata_or_out_of_bounds"), "99": ("99", 1000.0, "missing_coordinates")}
    numbers = spark.createDataFrame([(5,), (12,)], "position long")
    assert {r.position: r.terrain_reason for r in terrain.lookup(numbers, coords, dem, grid).collect()} == {5: None, 12: "missing_coordinates"}
    assert {r.terrain_reason for r in terrain.lookup(numbers, coords, None, grid).collect()} == {"missing_dem"}


def test_resolved_keys(spark):
    towers = lambda *p: spark.createDataFrame(list(enumerate(p)), "index long, position string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = lambda t, k: [(r.key, r.problem) for r in terrain.resolved_keys(t, k).orderBy("index").collect()]
    assert got(towers("x", "y"), keys("0", "1")) == [("0", None), ("1", None)] and got(towers("x", "y"), keys("x", "y")) == [("x", None), ("y", None)]
    assert got(towers("1", "0"), keys("0", "1")) == [("0", "ambiguous"), ("1", "ambiguous")] and got(towers("0", "1"), keys("0", "1")) == [("0", None), ("1", None)]
    assert got(towers("1", "y"), keys("1")) == [("1", "ambiguous"), ("1", "ambiguous")]  # two towers for one key
    assert got(towers("x", "y", "z"), keys("0", "y")) == [("0", None), ("y", None), (None, None)] and got(towers("x", "y", "z"), keys("0", "x")) == [("0", "ambiguous"), (None, None), (None, None)]
