"""Hashes that need no order, hashes of ordered content, and candidates of one key one after the other."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanwatt.config import Conductor
from spanwatt.operators import identity, registry

T0 = dt.datetime(2024, 1, 1)
WEATHER = "line_id string, tower_id string, timestamp timestamp_ntz, ambient_temp double, wind_speed double, wind_angle_deg double, solar_radiation double, elevation double"
WIRE = Conductor(0.0281, 7.283e-5, 8.688e-5, 1.220e-4, (("aluminum", 1.116),))


def rows_of(n: int = 6, **x):
    base = [("l", f"{k % 2}", T0 + dt.timedelta(minutes=30 * (k // 2)), 10.0 + k, 0.0, 45.0, 0.0, 100.0 + k) for k in range(n)]
    names = WEATHER.replace(" string", "").replace(" timestamp_ntz", "").replace(" double", "").split(", ")
    return [tuple(x.get(c, v) if k == 0 else v for c, v in zip(names, r, strict=True)) for k, r in enumerate(base)]


def test_rating_input_hash(spark):
    make = lambda rows: spark.createDataFrame(rows, WEATHER)
    digest = lambda rows, wire=WIRE, **x: identity.rating_input_hash(make(rows), wire, **x).first().input_hash
    plain = digest(rows_of())
    assert plain == digest(rows_of()[::-1]) == digest(rows_of(wind_speed=-0.0))
    assert plain == digest(rows_of()[:5] + [rows_of()[5][:-1] + (900.0,)])  # only a tower's first elevation counts
    changed = [digest(rows_of(ambient_temp=10.5)), digest(rows_of(elevation=1.0)), digest(rows_of(), Conductor(0.03, 7e-5, 8e-5, 1e-4)), digest(rows_of() + rows_of()[:1]), digest(rows_of(), window=(0.0, 1.0))]
    assert len({plain, *changed}) == 6
    transient = [digest(rows_of(), window=x) for x in ((0.0, 1.0), (-5.0, 90.0), (0.5, 1.0), (7.0, 8.0), (9.0, 11.0))]
    assert transient[0] == transient[1] and transient[3] == transient[4] and len(set(transient)) == 3  # cut to the hour that the weather covers
    assert digest(rows_of(), window=(0.0, 1.0), initial_temp=50.0) not in transient
    with pytest.raises(Exception, match="not finite"):
        digest(rows_of(ambient_temp=float("nan")))
    with pytest.raises(Exception, match="not finite"):
        digest(rows_of(wind_speed=None))


def test_ordered_hash(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    digest = lambda d: identity.ordered_hash(d, ["v"], "id", []).first().content_hash
    plain = digest(df)
    assert plain == digest(df.orderBy(F.desc("id")).repartition(3))
    swapped = df.withColumn("id", F.when(F.col("id") == 0, 1).when(F.col("id") == 1, 0).otherwise(F.col("id")))
    assert len({plain, digest(swapped), digest(df.where("id < 4999")), digest(df.withColumn("v", F.col("v") + 1))}) == 4
    tagged = df.withColumn("line_id", F.lit("a"))
    alone = identity.ordered_hash(tagged, ["v"], "id", ["line_id"]).first().content_hash
    both = identity.ordered_hash(tagged.unionAll(df.where("id < 3").withColumn("line_id", F.lit("b"))), ["v"], "id", ["line_id"]).collect()
    assert {r.line_id: r.content_hash for r in both}["a"] == alone == plain  # other groups don't matter


def test_training_hash(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 2.0)], "key string, x double")
    digest = lambda d, t="wind_speed": identity.training_hash(d, ["x", "x"], ["key"], t).first().content_hash
    assert digest(df) == digest(df.orderBy(F.desc("x"))) != digest(df, "ambient_temp")
    assert digest(df) != digest(df.unionAll(df))


def test_line_identity(spark):
    w = spark.createDataFrame([("l", "1", T0, "f"), ("l", "2", T0, "f")], "line_id string, tower_id string, timestamp timestamp_ntz, source_file_hash string")
    make = lambda *rows: spark.createDataFrame(list(rows), "tower_id string, lon double, lat double")
    name = lambda weather, places: identity.line_identity(weather, places).first()
    known = name(w, make(("1", 100.0, 40.0), ("2", 100.1, 40.0)))
    assert known.persistent and known.towers == 2 and known.identity.startswith("line-coordinates-") and len(known.identity) == 41
    assert known.identity == name(w.withColumn("source_file_hash", F.lit("g")), make(("2", 100.1, 40.0), ("1", 100.0, 40.0), ("1", 100.0, 40.0))).identity
    assert known.identity != name(w, make(("1", 100.0, 40.0), ("2", 100.2, 40.0))).identity
    lost, twice = name(w, make(("1", 100.0, 40.0))), name(w, make(("1", 100.0, 40.0), ("2", 100.1, 40.0), ("2", 101.0, 40.0)))
    assert lost.reason == "missing_coordinates" and twice.reason == "ambiguous_coordinates" and twice.towers == 2 and not lost.persistent
    assert lost.identity != name(w.withColumn("source_file_hash", F.lit("g")), make(("1", 100.0, 40.0))).identity


CANDIDATE = "line_id string, tower_id string, target string, generation_id string, created_at long, outcome string, evaluation string, evaluation_set_hash string, training_contract_hash string, baseline_mae double, corrected_mae double, model_version string, expected_version string"


def candidate(gid: str, at: int, mae: float, version: str, expected: str | None = None, tower: str = "1", evaluation: str = "holdout"):
    return ("l", tower, "wind_speed", gid, at, "trained", evaluation, "s", "c", 9.0, mae, version, expected)


def test_promotion_chain(spark):
    """Three candidates of a key: one head, each held against the one before, two generations kept."""
    rows = [candidate("a", 1, 5.0, "v1"), candidate("b", 2, 4.0, "v2", "v1"), candidate("c", 3, 3.0, "v3", "v2"), candidate("d", 4, 3.0, "v4"), candidate("e", 5, 1.0, "v5", "v1"), candidate("x", 1, 2.0, "v1", tower="2", evaluation="full_fit")]
    decisions, heads = registry.promote(spark.createDataFrame(rows[::-1], CANDIDATE))
    got = {r.generation_id: (r.reason, r.champion_id, r.revision) for r in decisions.collect()}
    assert got == {"a": ("promoted", None, 1), "b": ("promoted", "a", 2), "c": ("promoted", "b", 3), "d": ("insufficient_mae_improvement", "c", 3), "e": ("model_version_conflict", "c", 3), "x": ("promoted_provisional", None, 1)}
    assert {(r.tower_id, r.generation_id, r.previous_id, r.revision) for r in heads.collect()} == {("1", "c", "b", 3), ("2", "x", None, 1)}
    more = [candidate("f", 9, 0.5, "v6", "v3"), candidate("y", 9, 0.5, "v2", tower="3")]
    _, after = registry.promote(spark.createDataFrame(more, CANDIDATE), heads)
    assert {(r.tower_id, r.generation_id, r.previous_id, r.revision) for r in after.collect()} == {("1", "f", "c", 4), ("2", "x", None, 1), ("3", "y", None, 1)}
    both = spark.createDataFrame([("l", "1", "wind_speed", True, "n", None), ("l", "1", "wind_speed", True, "m", None)], "line_id string, tower_id string, target string, promote boolean, generation_id string, expected_generation string")
    with pytest.raises(Exception, match="two promoted"):
        registry.apply_promotions(heads.select(*registry.KEYS, "generation_id", "revision"), both).collect()


def test_long_chain(spark):
    """More candidates than one fold takes."""
    rows = [candidate(f"g{k:04}", k, 8.0 - k / 200, f"v{k}") for k in range(1100)]
    decisions, heads = registry.promote(spark.createDataFrame(rows, CANDIDATE))
    assert decisions.where("promote").count() == 1100 and [(r.generation_id, r.previous_id, r.revision) for r in heads.collect()] == [("g1099", "g1098", 1100)]
