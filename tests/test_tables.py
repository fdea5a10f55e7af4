"""Quality, grids, alignment, features, registry, sag, files and streams on small tables."""

import datetime as dt
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwatt.config import Conductor
from spanwatt.functions import parsing
from spanwatt.operators import align, audit, features, identity, models, quality, ratings, registry, resample, sag
from spanwatt.sources import tables, weather
from spanwatt.streaming import rating_stream

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def frame(spark, rows):
    """rows: tower, minutes, temperature, wind, direction."""
    full = [(k, "line-0", t, at(m), a, w, d, 100.0, 50.0, 800.0, "physical", "h") for k, (t, m, a, w, d) in enumerate(rows)]
    return spark.createDataFrame(full, "row_order long, line_id string, tower_id string, timestamp timestamp_ntz, ambient_temp double, wind_speed double, wind_direction double, solar_radiation double, humidity double, elevation double, dataset_role string, source_file_hash string")


def test_parsing(spark):
    df = spark.createDataFrame([("014号",), ("7",), ("12.0",), ("1.5号",), ("x",), ("a 3 b",), ("T-09",), (None,)], "t string")
    got = df.select(parsing.tower_id(F.col("t")).alias("a"), parsing.tower_number(F.col("t")).alias("b"), parsing.coordinate_tower_id(F.col("t")).alias("c"), parsing.number(F.col("t")).alias("d")).collect()
    assert [r.a for r in got] == ["014", "7", "12", None, None, None, None, None]
    assert [r.b for r in got] == [14, 7, 12, 1, None, 3, 9, None]
    assert [r.c for r in got][:3] == ["014", "7", "12"] and got[6].c == "09"
    times = spark.createDataFrame([("2026/7/23", "1:30"), ("2026-07-23", "2020-01-01 02:00:05"), ("2026-07-23", "x")], "d string, t string").select(parsing.date_and_time(F.col("d"), F.col("t")).alias("x")).collect()
    assert [r.x for r in times] == [dt.datetime(2026, 7, 23, 1, 30), dt.datetime(2026, 7, 23, 2, 0, 5), None]
    zone = spark.createDataFrame([("2026-07-23 08:00",), ("2026-07-23T08:00:00+02:00",), ("bad",)], "t string")
    assert [r[0] for r in zone.select(parsing.instant(F.col("t"))).collect()] == [dt.datetime(2026, 7, 23), dt.datetime(2026, 7, 23, 6), None]
    odd = spark.createDataFrame([("2026-03-29 02:30",), ("2026-10-25 02:30",), ("2026-07-01 02:30",)], "t string")
    assert [r[0] for r in odd.select(parsing.instant(F.col("t"), "Europe/Berlin")).collect()] == [None, None, dt.datetime(2026, 7, 1, 0, 30)]


def test_quality(spark):
    inf = float("inf")
    df = frame(spark, [("1", 0, 20.0, 3.0, 360.0), ("1", 0, 21.0, 3.0, 10.0), ("1", 30, 20.0, inf, 0.0), (None, 0, None, 3.0, 400.0)])
    got = {r.row_order: r for r in quality.validated(df).collect()}
    assert got[0].reasons == [] and got[0].wind_direction == 0.0 and got[2].reasons == ["wind_speed_out_of_range"]
    assert got[3].reasons == ["invalid_tower_id", "missing_ambient_temp", "wind_direction_out_of_range"]
    assert [r.row_order for r in quality.clean_weather(df).collect()] == [0]
    total = {r.reason: r.rows for r in quality.merged_report(df, ["row_order"]).where("source_file_hash is null").collect()}
    assert (total["input_rows"], total["valid_rows"], total["dropped_rows"], total["duplicate_tower_timestamp"]) == (4, 1, 3, 1)
    with pytest.raises(Exception, match="of the role truth"):
        quality.require_role(df, "truth").count()
    with pytest.raises(ValueError):
        quality.require_unique(df, ["tower_id", "timestamp"])
    with pytest.raises(ValueError):
        quality.require_disjoint(df, df)
    assert quality.same_content(df, df, ["tower_id", "ambient_temp"]).first().equal


def test_resample(spark):
    df = frame(spark, [("001", 0, 10.0, 1.0, 350.0), ("001", 60, 20.0, None, 10.0), ("001", 75, 30.0, 4.0, 10.0), ("002", 5, 50.0, 1.0, 0.0)])
    got = {(r.tower_id, r.timestamp): r for r in resample.resample(df, 30).collect()}
    assert sorted(got) == [("001", at(0)), ("001", at(30)), ("001", at(60)), ("001", at(75)), ("002", at(5))]
    half = got["001", at(30)]
    assert half.ambient_temp == 15.0 and half.wind_direction == pytest.approx(0, abs=1e-9) and half.wind_speed == pytest.approx(1 + 3 * 30 / 75)
    assert got["001", at(75)].ambient_temp == 30.0 and got["002", at(5)].ambient_temp == 50.0
    axis = resample.common_axis(frame(spark, [("1", 0, 10.0, 1.0, 10.0), ("1", 60, 20.0, 3.0, 30.0), ("2", 30, 5.0, 1.0, 0.0)]), 30).collect()
    assert {(r.tower_id, r.step): (r.ambient_temp, r.wind_speed) for r in axis}[("1", 1)] == (15.0, 2.0) and {r.ambient_temp for r in axis if r.tower_id == "2"} == {5.0}


def test_asof(spark):
    physical = frame(spark, [("001", 10, 1.0, 1.0, 0.0), ("002", 10, 1.0, 1.0, 0.0), ("003", 10, 1.0, 1.0, 0.0)]).withColumn("measurement_height", F.lit(10.0))
    truth = frame(spark, [("001", 8, 5.0, 2.0, 0.0), ("001", 11, 6.0, 2.0, 0.0), ("002", 9, 7.0, 2.0, 0.0), ("002", 9, 8.0, 2.0, 0.0), ("003", -1, 8.0, 2.0, 0.0)]).withColumn("measurement_height", F.lit(2.0))
    got = {r.tower_id: r for r in align.normalise_height(align.asof(physical, truth, 10)).collect()}
    assert got["001"].truth_time == at(8) and got["002"].ambient_temp_truth_raw == 8.0 and not got["003"].matched
    assert got["001"].wind_speed_truth == pytest.approx(2 * 5**0.15) and got["001"].height_normalized
    report = align.report(align.asof(physical, truth, 10), truth).first()
    assert (report.physical_rows, report.truth_rows, report.matched_rows, report.coverage) == (3, 5, 2, pytest.approx(2 / 3))


def test_features(spark):
    df = frame(spark, [("1", 0, 1.0, 1.0, 0.0), ("1", 30, 1.0, 2.0, 0.0), ("1", 61, 1.0, 3.0, 0.0), ("2", 30, 1.0, 9.0, 0.0)])
    got = {r.row_order: r for r in features.features(df, "wind_speed").collect()}
    assert [got[k].lag_1 for k in range(4)] == [1.0, 1.0, 3.0, 9.0] and [got[k].segment for k in range(4)] == [0, 0, 1, 0]
    assert got[0].hour_sin == pytest.approx(np.sin(2 * np.pi * 8 / 24))
    rows = features.segments(df.withColumns({"target": F.lit("wind_speed")}))
    assert {r.row_order: r.split for r in features.holdout(rows).collect()} == {0: "train", 1: "train", 2: "holdout", 3: "full_fit"}


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [("1", 30 * k + 600 * (k > 80), 10.0, float(w), float(d)) for k, (w, d) in enumerate(zip(rng.uniform(1, 9, 120), rng.uniform(0, 359, 120), strict=True))]
    df = frame(spark, rows).withColumns({"target": F.lit("wind_speed"), "physical": F.col("wind_speed"), "matched": F.lit(True)})
    df = df.withColumn("truth", F.col("physical") + 0.3 * (F.col("physical") - 5.0)).withColumn("residual", F.col("truth") - F.col("physical"))
    ready = features.holdout(features.features(df, "physical"))
    fitted = models.fit(ready)
    one = fitted.first()
    assert one.evaluation == "holdout" and one.outcome == "trained" and one.corrected_mae < 0.3 * one.baseline_mae
    assert models.fit(ready.orderBy(F.rand(1))).first().corrected_mae == one.corrected_mae
    made = models.predict(ready, fitted).collect()
    assert all(r.final == pytest.approx(r.physical + r.residual) and (r.used_ai or r.fallback_reason == "physical_bounds_exceeded") for r in made) and any(r.used_ai for r in made)
    assert {r.fallback_reason for r in models.predict(ready, fitted.limit(0)).collect()} == {"model_unavailable"}

    def broken(x, y):
        raise RuntimeError

    assert models.fit(ready, broken).first().outcome == "data_fallback:RuntimeError"
    assert models.new_model(np.zeros((3, 2)), np.full(3, 0.5)).predict(np.zeros((1, 2)))[0] == 0.5


def test_registry(spark):
    key = {"line_id": "l", "tower_id": "1", "target": "wind_speed"}
    base = key | {"outcome": "trained", "evaluation": "holdout", "evaluation_set_hash": "s", "training_contract_hash": "c", "baseline_mae": 2.0, "corrected_mae": 1.0, "model_version": "v2", "expected_version": "v1"}
    schema = "line_id string, tower_id string, target string, outcome string, evaluation string, evaluation_set_hash string, training_contract_hash string, baseline_mae double, corrected_mae double, model_version string, expected_version string"
    make = lambda **x: spark.createDataFrame([tuple((base | x).values())], schema)
    head = make(corrected_mae=1.5, model_version="v1")
    reason = lambda c, h: registry.decide(c, h).first().reason
    assert reason(make(), head) == "promoted" and reason(make(), head.limit(0)) == "promoted" and reason(make(evaluation="full_fit"), head) == "full_fit_cannot_replace_champion"
    assert reason(make(corrected_mae=1.5), head) == "insufficient_mae_improvement" and reason(make(corrected_mae=2.0), head) == "candidate_not_better_than_physical"
    assert reason(make(expected_version="v0"), head) == "model_version_conflict" and reason(make(evaluation_set_hash="t"), head) == "evaluation_set_mismatch"
    assert reason(make(training_contract_hash="d"), head) == "promoted_contract_refresh" and reason(make(), make(evaluation="full_fit", model_version="v1")) == "promoted_from_provisional"


def test_identity(spark):
    df = frame(spark, [("1", 0, 0.0, 1.0, 0.0), ("1", 30, 2.0, 1.0, 0.0), ("2", 0, 3.0, 1.0, 0.0)])
    digest = lambda d: identity.content_hash(d, ["tower_id", "timestamp", "ambient_temp"], ["line_id"]).first().content_hash
    assert digest(df) == digest(df.orderBy(F.desc("row_order"))) == digest(df.withColumn("ambient_temp", F.when(F.col("ambient_temp") == 0, -0.0).otherwise(F.col("ambient_temp"))))
    assert digest(df) != digest(df.withColumn("ambient_temp", F.col("ambient_temp") + 1))


def test_ratings(spark):
    df = spark.createDataFrame([("l", "b", T0, 10.0), ("l", "a", T0, 10.0), ("l", "c", T0, 12.0), ("l", "a", at(30), 1.0)], "line_id string, tower_id string, timestamp timestamp_ntz, rating_a double")
    assert ratings.common_times(df).count() == 3
    worst = ratings.bottleneck(ratings.common_times(df)).first()
    assert (worst.line_rating_a, worst.bottleneck_tower, worst.towers) == (10.0, "a", 3)
    assert ratings.publish(df.withColumn("raw_rating_a", F.lit(100.0))).first().rating_a == 80.0


def sample(**x):
    return {"angle_deg": 8.0, "measured_temp_c": 60.0, "theoretical_temp_c": 60.0, "ambient_temp_c": 20.0, "temperature_error_c": 0.0, "wind_speed": 1.0, "span_m": 300.0, "original_current_a": 1000.0, "recalculated_current_a": 900.0, "error_code": None} | x


def test_sag_machine():
    m = sag.Memory()
    assert sag.step(m, sample(measured_temp_c=65.0, temperature_error_c=5.0))["state"] == "NORMAL"  # not above the threshold
    m = sag.Memory()
    risk = sag.step(m, sample(measured_temp_c=80.0, temperature_error_c=20.0))
    assert risk["state"] == "RISK" and risk["final_current_a"] == pytest.approx(816.4966, abs=1e-3)
    before = (m.state, m.last, list(m.errors))
    assert sag.step(m, sample(error_code="invalid_angle"))["final_current_a"] == risk["final_current_a"] and (m.state, m.last, m.errors) == before
    states = [sag.step(m, sample()) for _ in range(40)]
    assert [s["state"] for s in states[:3]] == ["RISK", "RISK", "RECOVERY"] and states[2]["final_current_a"] == pytest.approx(250 + 0.75 * risk["final_current_a"])
    assert states[-1]["state"] == "NORMAL" and states[-1]["final_current_a"] == 1000.0


def sag_rows(spark):
    rows = []
    for tower in ("1", "2"):
        for k in range(30):
            hot = 20.0 if k in (3, 4) and tower == "1" else 0.0
            rows.append((tower, k, *sample(measured_temp_c=60.0 + hot, temperature_error_c=hot, error_code="invalid_angle" if k == 7 else None).values()))
    return spark.createDataFrame(rows, "tower_id string, sample_index long, angle_deg double, measured_temp_c double, theoretical_temp_c double, ambient_temp_c double, temperature_error_c double, wind_speed double, span_m double, original_current_a double, recalculated_current_a double, error_code string")


def test_rating_stream(spark):
    df = frame(spark, [("1", 0, 20.0, 3.0, 90.0), ("1", 0, 20.0, 3.0, 90.0), ("2", 0, 20.0, 99.0, 90.0), ("2", 30, 20.0, 3.0, 0.0)])
    folder = tempfile.mkdtemp(prefix="spark-")
    df.write.parquet(f"{folder}/in")
    made = rating_stream.rate_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), Conductor.named("ACSR Drake (795 kcmil)"))
    query = made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(r.tower_id for r in rows) == ["1", "2"] and all(r.rating_a > 0 for r in rows)


def test_files(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    legacy = "位置,日期,时刻,环境温度,风速,风向,太阳辐射强度,相对湿度,海拔\n36,2025-12-10,00:00,20,3.2,90,0,40,1100\n36,2025-12-10,01:00,21,x,95,30,41,1100\n"
    towers = "时间,杆塔,经度,纬度,风速WS(m/s),风向WD(°),温度TEM(℃),相对湿度RHU(%)\n2026-07-23 00:00,014号,120.6982,49.2871,1.6,172,16.96,66.1\n2026-07-23 00:00,014号,120.6982,49.2871,9.9,172,16.96,66.1\n"
    (folder / "a.csv").write_bytes(legacy.encode("gb18030"))
    (folder / "b.csv").write_bytes(towers.encode("utf-8-sig"))
    (folder / "bad.csv").write_bytes(b"\xff\xff\xff\xff")
    paths = [str(folder / n) for n in ("a.csv", "b.csv")]
    df, report = weather.ingest(spark, paths, "physical")
    got = {r.tower_id: r for r in df.collect()}
    assert sorted(got) == ["014", "36"] and got["36"].timestamp == dt.datetime(2025, 12, 9, 16) and got["014"].wind_speed == 1.6 and got["014"].solar_radiation == 0.0
    total = {r.reason: r.rows for r in report.where("source_file_hash is null").collect()}
    assert total["input_rows"] == 4 and total["missing_wind_speed"] == 1 and total["duplicate_tower_timestamp"] == 1
    with pytest.raises(ValueError):
        weather.ingest(spark, [*paths, str(folder / "bad.csv")], "physical")
    assert weather.ingest(spark, [*paths, str(folder / "bad.csv")], "physical", skip_bad=True)[0].count() == 2
    assert weather.ingest_truth(spark, [str(folder / "bad.csv")]) is None
    (folder / "p.csv").write_text("线路表,,\n运行编号,经度,纬度\nT-01,120.1,40\nT-02,x,40\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_places(spark, str(folder / "p.csv")).collect()] == [("T-01", 120.1, 40.0)]
    (folder / "i.csv").write_text("倾角,杆塔\n8.5,001号\n9,001号\n", encoding="utf-8")
    axis = spark.createDataFrame([(at(0),), (at(30),)], "timestamp timestamp_ntz")
    rows = tables.read_inclination(spark, [str(folder / "i.csv")], axis=axis).orderBy("sample_index").collect()
    assert [(r.tower_id, r.angle_deg, r.timestamp, r.timestamp_source) for r in rows] == [("001", 8.5, at(0), "snapshot"), ("001", 9.0, at(30), "snapshot")]
    tables.write_csv(df.select("tower_id"), str(folder / "out"))
    assert next((folder / "out").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")


def test_audit(spark):
    df = spark.createDataFrame([("r", "x", "l", "1", "i", "c", "s", "why"), ("r", "y", "l", "", "i", "c", "s", None)], "run_id string, result_id string, line_id string, tower_id string, input_hash string, config_hash string, source string, fallback_reason string")
    log = audit.events(df, "rating", ["source"])
    assert log.count() == 1 and log.first().details == '{"source":"s"}'
    path = tempfile.mkdtemp(prefix="spark-") + "/log"
    assert audit.append(log, path) and audit.append(log, path) and spark.read.json(path).count() == 2
    assert not audit.append(log, "nowhere://x/y")
    assert {(r.stage, r.fallback_reason): r.events for r in audit.summary(log).collect()}[("rating", "why")] == 1
