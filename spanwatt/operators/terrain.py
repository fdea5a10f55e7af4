"""Terrain of towers from a grid of elevations, and its join with weather."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from spanwatt.functions.parsing import coordinate_tower_id, tower_id

# The ellipsoid of WGS 84.
SEMI_MAJOR_M, ECCENTRICITY_2 = 6378137.0, 0.0066943799901413165


@dataclass(frozen=True)
class Affine:
    """Where cell (0, 0) begins and how far cells are apart; rows run south."""

    lon0: float
    lat0: float
    dlon: float
    dlat: float

    def __post_init__(self) -> None:
        if not (self.dlon > 0 and self.dlat > 0):
            raise ValueError("cells need a positive size")


def tower_coordinates(raw: DataFrame, label: str = "label") -> DataFrame:
    """(tower_id, lon, lat): rows whose label or place can't be read are left out, equal
    repetitions are one, and a tower with two different places is left out entirely."""
    rows = raw.select(coordinate_tower_id(F.col(label)).alias("tower_id"), "lon", "lat")
    rows = rows.where("tower_id is not null and abs(lon) <= 180 and abs(lat) <= 90")
    one = rows.groupBy("tower_id").agg(F.min("lon").alias("lon"), F.max("lon").alias("lon1"), F.min("lat").alias("lat"), F.max("lat").alias("lat1"))
    return one.where("lon = lon1 and lat = lat1").select("tower_id", "lon", "lat")


def labelled_towers(raw: DataFrame, label: str = "label") -> DataFrame:
    """tower_id of every tower of the table, those with two different places too."""
    rows = raw.select(coordinate_tower_id(F.col(label)).alias("tower_id"), "lon", "lat")
    return rows.where("tower_id is not null and abs(lon) <= 180 and abs(lat) <= 90").select("tower_id").distinct()


def _number(c: str) -> Column:
    return F.col(c).try_cast("long")


def requested_coordinates(coords: DataFrame, known: DataFrame, requested: DataFrame, request: str = "request") -> DataFrame:
    """request, tower_id, lon, lat of the requests that name a tower of ``coords``.

    A request that is a number takes the tower whose id has that value, if just one of ``known`` has it; ids with two
    places are among these, so they too make a number ambiguous.  A text takes the tower of exactly that id.
    """
    asked = requested.select(request).distinct()
    if isinstance(asked.schema[request].dataType, NumericType):
        single = known.select("tower_id", _number("tower_id").alias("_n")).where("_n is not null").groupBy("_n").agg(F.count("*").alias("_k"), F.min("tower_id").alias("tower_id")).where("_k = 1")
        whole = F.col(request).cast("double")
        asked = asked.where((whole >= 0) & (whole == F.floor(whole))).withColumn("_n", F.col(request).cast("long"))
        named = asked.join(single, "_n").select(request, "tower_id")
    else:
        named = asked.select(request, tower_id(F.col(request)).alias("tower_id")).where("tower_id is not null")
    return named.join(coords, "tower_id").select(request, "tower_id", "lon", "lat")


def lookup(positions: DataFrame, coords: DataFrame, dem: DataFrame | None, affine: Affine, position: str = "position") -> DataFrame:
    """The terrain of weather towers by whatever their column holds: position, tower_id and the columns of ``sample``.

    Numbers (legacy positions) find the place whose id has that value, if just one has.  Texts find the place of that very
    id, else of their normal form, else the first whose own normal form is that.  Without a grid, or without a place, the
    sample is the default one and says why.
    """
    asked = positions.select(position).distinct()
    if isinstance(asked.schema[position].dataType, NumericType):
        asked = asked.withColumns({"tower_id": F.col(position).cast("long").cast("string"), "_n": F.col(position).cast("long")})
        places = coords.withColumn("_n", _number("tower_id")).where("_n is not null").groupBy("_n").agg(F.count("*").alias("_k"), F.min(F.struct("lon", "lat")).alias("p")).where("_k = 1")
        found = asked.join(places, "_n", "left").select(position, "tower_id", "p.lon", "p.lat")
    else:
        asked = asked.withColumn("tower_id", F.coalesce(tower_id(F.col(position)), F.trim(position)))
        place = F.struct("lon", "lat")
        plain = coords.groupBy(F.col("tower_id").alias("_a")).agg(F.min(place).alias("pa"))
        normal = coords.groupBy(tower_id(F.col("tower_id")).alias("_b")).agg(F.min_by(place, "tower_id").alias("pb")).where("_b is not null")
        found = asked.join(plain, F.col("tower_id") == F.col("_a"), "left").drop("_a").join(plain.select(F.col("_a").alias("_o"), F.col("pa").alias("po")), F.col(position) == F.col("_o"), "left").join(normal, F.col("tower_id") == F.col("_b"), "left")
        found = found.withColumn("p", F.coalesce("pa", "po", "pb")).select(position, "tower_id", "p.lon", "p.lat")
    if dem is None:
        level = {"slope": 0.0, "aspect": 0.0, "terrain_elevation": 1000.0, "terrain_source": "default", "terrain_reason": "missing_dem"}
        return found.select(position, "tower_id", *[F.lit(v).alias(k) for k, v in level.items()])
    sampled = sample(found.select(F.col(position).cast("string").alias("tower_id"), "lon", "lat"), dem, affine).withColumnRenamed("tower_id", "_p")
    return found.select(position, "tower_id").join(sampled, F.col(position).cast("string") == F.col("_p")).drop("_p")


def cells(dem: DataFrame) -> DataFrame:
    """Usable cells: neither masked nor without a finite elevation."""
    return dem.where("not masked and abs(elevation) < 1e300").select("row", "col", F.col("elevation").alias("z"))


def _radii(lat: Column) -> tuple[Column, Column]:
    """Metres per radian north and east at a latitude."""
    w = 1.0 - ECCENTRICITY_2 * F.pow(F.sin(F.radians(lat)), F.lit(2.0))
    return SEMI_MAJOR_M * (1.0 - ECCENTRICITY_2) / F.pow(w, F.lit(1.5)), SEMI_MAJOR_M / F.sqrt(w) * F.cos(F.radians(lat))


def sample(towers: DataFrame, dem: DataFrame, affine: Affine) -> DataFrame:
    """tower_id, slope, aspect, elevation, terrain_source, terrain_reason for every tower.

    A plane is fitted to the usable cells around the tower's cell; it needs three cells that
    are not in line.  Outside of the grid, or in an unusable cell, the sample is the default
    one: level, 1000 m.  Towers (few) are spread over their nine cells and meet the grid in an
    equi-join; the fit is a sum by tower.
    """
    at = towers.select("tower_id", F.floor((F.col("lon") - affine.lon0) / affine.dlon).alias("c0"), F.floor((affine.lat0 - F.col("lat")) / affine.dlat).alias("r0"))
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    near = at.select("tower_id", "r0", "c0", offsets).select("tower_id", "r0", "c0", "o.dr", "o.dc", (F.col("r0") + F.col("o.dr")).alias("row"), (F.col("c0") + F.col("o.dc")).alias("col"))
    north, east = _radii(affine.lat0 - (F.col("r0") + 0.5) * affine.dlat)
    found = near.join(cells(dem), ["row", "col"]).withColumns({"e": F.radians(F.lit(affine.dlon)) * F.col("dc") * east, "n": -F.radians(F.lit(affine.dlat)) * F.col("dr") * north})
    e, n, z = F.col("e"), F.col("n"), F.col("z")
    sums = {"k": F.count("*"), "e": F.sum(e), "n": F.sum(n), "z": F.sum(z), "ee": F.sum(e * e), "nn": F.sum(n * n), "en": F.sum(e * n), "ez": F.sum(e * z), "nz": F.sum(n * z)}
    fit = found.groupBy("tower_id").agg(*[v.alias("s_" + k) for k, v in sums.items()], F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), z)).alias("centre"))

    def moment(a: str, b: str) -> Column:
        return F.col("s_" + a + b) - F.col("s_" + a) * F.col("s_" + b) / F.col("s_k")

    fit = fit.withColumns({a + b: moment(a, b) for a, b in ("ee", "nn", "en", "ez", "nz")}).withColumn("det", F.col("ee") * F.col("nn") - F.col("en") * F.col("en"))
    plane = (F.col("s_k") >= 3) & (F.col("det") > 1e-6 * F.pow(F.col("ee") + F.col("nn"), F.lit(2.0)))
    fit = fit.withColumns({"ge": F.when(plane, (F.col("ez") * F.col("nn") - F.col("nz") * F.col("en")) / F.col("det")).otherwise(0.0), "gn": F.when(plane, (F.col("nz") * F.col("ee") - F.col("ez") * F.col("en")) / F.col("det")).otherwise(0.0)})
    rise = F.sqrt(F.col("ge") * F.col("ge") + F.col("gn") * F.col("gn"))
    flat = rise <= 1e-9
    turn = F.pmod(F.degrees(F.atan2(-F.col("ge"), -F.col("gn"))), F.lit(360.0))
    out = towers.select("tower_id", F.col("lon").isNull().alias("lost")).join(fit, "tower_id", "left")
    good = F.col("centre").isNotNull()
    return out.select(
        "tower_id",
        F.when(good & ~flat, F.degrees(F.atan(rise))).otherwise(0.0).alias("slope"),
        F.when(good & ~flat & (turn < 360.0 - 1e-9), turn).otherwise(0.0).alias("aspect"),
        F.when(good, F.col("centre")).otherwise(1000.0).alias("terrain_elevation"),
        F.when(good, "dem").otherwise("default").alias("terrain_source"),
        F.when(F.col("lost"), "missing_coordinates").when(~good, "nodata_or_out_of_bounds").alias("terrain_reason"),
    )


def join_terrain(weather: DataFrame, terrain: DataFrame) -> DataFrame:
    """The terrain's elevation takes the place of the weather's wherever the tower has a
    sample, even a default one; other towers keep theirs and lie on level ground."""
    both = weather.join(terrain, "tower_id", "left")
    return both.withColumns({
        "elevation": F.coalesce("terrain_elevation", "elevation"), "slope": F.coalesce("slope", F.lit(0.0)), "aspect": F.coalesce("aspect", F.lit(0.0)),
        "terrain_source": F.coalesce("terrain_source", F.lit("weather")),
    }).drop("terrain_elevation")


def resolved_keys(towers: DataFrame, keys: DataFrame) -> DataFrame:
    """index, position, key, problem: which key of a table of terrain is meant for each tower of a matrix.

    towers: index, position, both unique; keys: column key.  Keys may be indexes or positions.  If both find a key for
    every tower they must agree; if just one does, it counts.  Else a tower takes the one key that either finds, and it is
    ambiguous if they find two, or if another tower finds the same one.
    """
    named = keys.select(F.col("key").cast("string").alias("key")).distinct()
    both = towers.withColumns({"_i": F.col("index").cast("string"), "_p": F.col("position").cast("string")})
    both = both.join(named.select(F.col("key").alias("_i"), F.col("key").alias("by_index")), "_i", "left").join(named.select(F.col("key").alias("_p"), F.col("key").alias("by_position")), "_p", "left")
    whole = both.agg(F.bool_and(F.col("by_index").isNotNull()).alias("_all_i"), F.bool_and(F.col("by_position").isNotNull()).alias("_all_p"))  # one row
    owned = both.select("index", F.explode(F.array_distinct(F.array_compact(F.array("by_index", "by_position")))).alias("key")).groupBy("key").agg(F.count("*").alias("_owners"))
    both = both.crossJoin(F.broadcast(whole))
    differ = F.col("by_index") != F.col("by_position")
    single = F.when(F.col("_all_i"), F.col("by_index")).when(F.col("_all_p"), F.col("by_position")).otherwise(F.coalesce("by_index", "by_position"))
    both = both.withColumn("key", single)
    both = both.join(owned, "key", "left")
    neither = ~F.col("_all_i") & ~F.col("_all_p")
    problem = F.when(F.col("_all_i") & F.col("_all_p") & differ, "ambiguous").when(neither & (F.coalesce(differ, F.lit(False)) | (F.col("_owners") > 1)), "ambiguous")
    return both.select("index", "position", "key", problem.alias("problem"))
