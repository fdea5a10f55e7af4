"""Identities and content hashes that don't depend on the order of rows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.config import Conductor


def row_hash(columns: list[str], doubles: set[str]) -> Column:
    """SHA-256 of a row: doubles as text, -0 as 0, nulls written."""
    text = lambda c: F.when(F.col(c) == 0, F.lit("0.0")).otherwise(F.col(c).cast("string")) if c in doubles else F.col(c).cast("string")
    plain = [F.coalesce(text(c), F.lit("null")) for c in columns]
    return F.sha2(F.to_json(F.struct(*[p.alias(c) for p, c in zip(plain, columns, strict=True)])), 256)


def _doubles(df: DataFrame) -> set[str]:
    return {c for c, kind in df.dtypes if kind in ("double", "float")}


#: The row hash is added up in parts of 32 bits, four of them.
PARTS = 4


def _added(row: Column) -> list[Column]:
    """Aggregates over a column of hex digests that no order of rows changes: the count, and the sum of each part."""
    part = lambda k: F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    return [F.count(row).cast("string"), *[F.coalesce(F.sum(part(k)), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(PARTS)]]


def _digest(row: Column, tag: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(tag), *_added(row)), 256)


def content_hash(df: DataFrame, columns: list[str], by: list[str], tag: str = "") -> DataFrame:
    """A hash of the multiset of rows of each key: 128 bits of the rows' hashes are added up where the rows are, so
    that nothing is collected and no order counts.  tag: goes into the hash, as do the columns' names."""
    return df.select(*by, row_hash(columns, _doubles(df)).alias("_h")).groupBy(*by).agg(_digest(F.col("_h"), tag).alias("content_hash"))


def training_hash(df: DataFrame, columns: list[str], by: list[str], target: str) -> DataFrame:
    """``content_hash`` of training or evaluation rows for a target."""
    columns = list(dict.fromkeys(columns))
    return content_hash(df, columns, by, json.dumps({"columns": columns, "target": target}, sort_keys=True))


#: Children of a node, and levels, of the hash of ordered content; the same for all sizes.
FAN, LEVELS = 2048, 3


def ordered_hash(df: DataFrame, columns: list[str], index: str, by: list[str]) -> DataFrame:
    """A hash that does depend on the order given by ``index``, a whole number from 0 on.

    A tree over ranges of the index: rows to blocks of FAN, blocks to blocks of FAN of these, and what is left to
    the root.  A node holds FAN digests at most, and the root one for FAN * FAN rows.
    """
    now = df.select(*by, F.col(index).cast("long").alias("i"), F.sha2(F.concat_ws("|", F.col(index).cast("string"), row_hash(columns, _doubles(df))), 256).alias("r"))
    for level in range(LEVELS):
        block = F.floor(F.col("i") / FAN) if level < LEVELS - 1 else F.lit(0).cast("long")
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]))
        now = now.withColumn("b", block).groupBy(*by, "b").agg(F.sha2(joined, 256).alias("r")).withColumnRenamed("b", "i")
    return now.select(*by, F.col("r").alias("content_hash"))


INPUT_VERSION = "rating-input-1"
INPUTS = ("ambient_temp", "wind_speed", "wind_angle_deg", "solar_radiation", "elevation")


def _plain(x: float) -> float:
    return 0.0 if x == 0 else float(x)


def conductor_text(conductor: Conductor) -> str:
    """The scalars of a conductor that a steady rating uses, as canonical JSON."""
    c = {k: _plain(getattr(conductor, k)) for k in ("diameter", "r25", "r75", "r200", "emissivity", "absorptivity", "max_temp")}
    return json.dumps(c, sort_keys=True)


def rating_input_hash(weather: DataFrame, conductor: Conductor, window: tuple[float, float] | None = None, initial_temp: float | None = None, by: str = "line_id") -> DataFrame:
    """(by, input_hash): a fingerprint of all that a rating is computed from.

    weather: ``by``, tower_id, timestamp and INPUTS, one row for a tower and time; of elevation a tower's first counts.  Rows in any
    order give the same hash, and -0 is 0.  window: hours of a transient rating, cut to what the weather covers; with it
    come the heat capacity and every tower's initial temperature (its first one unless given).  A value that is missing or not
    finite fails the job.
    """
    sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) & ~F.isnan(F.col(c).cast("double")) for c in INPUTS])
    rows = weather.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error("an input of the rating is not finite").cast("boolean")))
    in_time = Window.partitionBy(by, "tower_id").orderBy("timestamp")
    begun = F.col("ambient_temp") if initial_temp is None else F.lit(_plain(initial_temp))
    rows = rows.withColumns({"elevation": F.first("elevation").over(in_time), "_n": F.row_number().over(in_time), "initial_temp": begun})
    doubles = _doubles(rows)
    start = F.when(F.col("_n") == 1, row_hash(["tower_id", "initial_temp"], doubles))
    hashed = rows.select(by, "timestamp", row_hash(["tower_id", "timestamp", *INPUTS], doubles).alias("_h"), start.alias("_i"))
    made = hashed.groupBy(by).agg(_digest(F.col("_h")).alias("w"), _digest(F.col("_i")).alias("initial"), F.timestamp_diff("SECOND", F.min("timestamp"), F.max("timestamp")).alias("span"))
    transient = F.lit("null")
    if window is not None:
        begin, end = max(_plain(window[0]), 0.0), F.least(F.lit(float(window[1])), F.col("span") / 3600.0)
        hours = F.when(end < begin, "empty").otherwise(F.concat_ws(",", F.lit(begin).cast("decimal(18,6)").cast("string"), end.cast("decimal(18,6)").cast("string")))
        transient = F.concat_ws("|", hours, F.lit(repr(_plain(conductor.heat_capacity))), "initial")
    return made.select(by, F.sha2(F.concat_ws("|", F.lit(INPUT_VERSION), "w", F.lit(conductor_text(conductor)), transient), 256).alias("input_hash"))


#: Places are told apart to 9 decimals of a degree.
PLACE = "decimal(12,9)"


def line_identity(weather: DataFrame, coords: DataFrame, content: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """line_id, towers, identity, persistent, reason: a line whose every tower has just one place,
    from the table of places or else from the weather, is named after its places; any other one after its
    places, its files and its weather (``content``), and does not last.

    Places, files and readings are multisets of rows, see ``content_hash``.
    """
    own = weather.select("line_id", "tower_id").distinct()
    table = coords.select("tower_id", "lon", "lat")
    if {"longitude", "latitude"} <= set(weather.columns):
        table = table.unionByName(weather.join(coords, "tower_id", "left_anti").select("tower_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")))
    table = table.where("abs(lon) <= 180 and abs(lat) <= 90").select("tower_id", F.col("lon").cast(PLACE).alias("lon"), F.col("lat").cast(PLACE).alias("lat")).distinct()
    places = own.join(table, "tower_id", "left").withColumn("n", F.count("lon").over(Window.partitionBy("line_id", "tower_id")))
    line = places.groupBy("line_id").agg(F.countDistinct("tower_id").alias("towers"), F.count_if(F.col("n") == 0).alias("lost"), F.count_if(F.col("n") > 1).alias("double"), _digest(row_hash(["tower_id", "lon", "lat"], set()), "places").alias("h"))
    files = weather.select("line_id", "source_file_hash").distinct().groupBy("line_id").agg(_digest(row_hash(["source_file_hash"], set()), "files").alias("f"))
    rows = content_hash(weather, ["tower_id", *content], ["line_id"], "content").withColumnRenamed("content_hash", "c")
    kept = (F.col("lost") == 0) & (F.col("double") == 0)
    reason = F.when(F.col("double") > 0, "ambiguous_coordinates").when(F.col("lost") > 0, "missing_coordinates")
    name = F.when(kept, F.concat(F.lit("line-coordinates-"), F.substring("h", 1, 24))).otherwise(F.concat(F.lit("line-runtime-"), F.substring(F.sha2(F.concat_ws("|", "h", "f", "c"), 256), 1, 24)))
    return line.join(files, "line_id").join(rows, "line_id").select("line_id", "towers", name.alias("identity"), kept.alias("persistent"), reason.alias("reason"))
