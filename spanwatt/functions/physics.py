"""The heat balance of an overhead conductor (IEEE 738) as column expressions, in W/m and SI units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwatt.config import CLEAR_SKY, HEAT_CAPACITY, SOLAR_ELEVATION, Conductor


def wind_angle_factor(angle: Column) -> Column:
    """K of the angle between wind and conductor; any angle folds to 0..90 degrees."""
    phi = F.pmod(angle, F.lit(180.0))
    phi = F.radians(F.least(phi, 180.0 - phi))
    return 1.194 - F.cos(phi) + 0.194 * F.cos(2 * phi) + 0.368 * F.sin(2 * phi)


def air(film: Column, elevation: Column) -> dict[str, Column]:
    """Density, viscosity and conductivity at the film temperature."""
    return {
        "density": (1.293 - 1.525e-4 * elevation + 6.379e-9 * elevation * elevation) / (1.0 + 0.00367 * film),
        "viscosity": 1.458e-6 * F.pow(film + 273.15, F.lit(1.5)) / (film + 383.4),
        "conductivity": 2.424e-2 + 7.477e-5 * film - 4.407e-9 * film * film,
    }


def convection(c: Conductor, surface: Column, ambient: Column, wind: Column, angle: Column, elevation: Column) -> dict[str, Column]:
    """Natural, forced at low and at high Reynolds numbers, and the one that counts.

    Negative where the air is warmer than the conductor.  Calm air has natural convection only.
    """
    a = air((surface + ambient) / 2.0, elevation)
    gap = F.abs(surface - ambient)
    sign = F.when(surface < ambient, -1.0).otherwise(1.0)
    calm = wind == 0.0
    reynolds = c.diameter * a["density"] * wind / a["viscosity"]
    forced = wind_angle_factor(angle) * a["conductivity"] * gap
    natural = 3.645 * F.sqrt(a["density"]) * c.diameter**0.75 * F.pow(gap, F.lit(1.25))
    low = F.when(calm, 0.0).otherwise(forced * (1.01 + 1.35 * F.pow(reynolds, F.lit(0.52))))
    high = F.when(calm, 0.0).otherwise(forced * 0.754 * F.pow(reynolds, F.lit(0.60)))
    return {"q_natural": sign * natural, "q_low": sign * low, "q_high": sign * high, "q_convection": sign * F.greatest(natural, low, high)}


def radiation(c: Conductor, surface: Column, ambient: Column) -> Column:
    """The standard adds 273 here, and 273.15 in the air's viscosity."""
    return 17.8 * c.diameter * c.emissivity * (F.pow((surface + 273.0) / 100.0, F.lit(4.0)) - F.pow((ambient + 273.0) / 100.0, F.lit(4.0)))


def measured_gain(c: Conductor, solar: Column) -> Column:
    return c.absorptivity * solar * c.diameter


def declination(day: Column) -> Column:
    return 23.45 * F.sin(F.radians((day + 284.0) / 365.0 * 360.0))


def solar_altitude(latitude: Column, day: Column, hour: Column) -> Column:
    """Degrees above the horizon, 0 when the sun is down."""
    lat, dec, omega = F.radians(latitude), F.radians(declination(day)), F.radians((hour - 12.0) * 15.0)
    height = F.cos(lat) * F.cos(dec) * F.cos(omega) + F.sin(lat) * F.sin(dec)
    return F.greatest(F.lit(0.0), F.degrees(F.asin(F.least(F.greatest(height, F.lit(-1.0)), F.lit(1.0)))))


def solar_azimuth(latitude: Column, day: Column, hour: Column) -> Column:
    """Degrees clockwise from north."""
    lat, dec, omega = F.radians(latitude), F.radians(declination(day)), F.radians((hour - 12.0) * 15.0)
    return F.pmod(F.degrees(F.atan2(F.sin(omega), F.sin(lat) * F.cos(omega) - F.cos(lat) * F.tan(dec))) + 180.0, F.lit(360.0))


def clear_sky_gain(c: Conductor, latitude: Column, day: Column, hour: Column, elevation: Column, line_azimuth: Column) -> Column:
    altitude, azimuth = solar_altitude(latitude, day, hour), solar_azimuth(latitude, day, hour)
    beam = reduce(lambda total, k: total * altitude + k, reversed(CLEAR_SKY), F.lit(0.0))
    a, b, d = SOLAR_ELEVATION
    beam = F.greatest(F.lit(0.0), beam) * (a + b * elevation + d * elevation * elevation)
    cosine = F.cos(F.radians(altitude)) * F.cos(F.radians(azimuth - line_azimuth))
    incidence = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when(altitude <= 0.0, 0.0).otherwise(c.absorptivity * beam * F.sin(incidence) * c.diameter)


def sunrise_sunset(latitude: Column, day: Column) -> tuple[Column, Column]:
    """Hours to one decimal."""
    cosine = -F.tan(F.radians(latitude)) * F.tan(F.radians(declination(day)))
    half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) / 15.0
    return F.round(12.0 - half, 1), F.round(12.0 + half, 1)


def resistance(c: Conductor, temperature: Column) -> Column:
    """Ohm per metre: linear over 25..75 up to 100 degrees, over 25..200 above."""
    low = c.r25 + (c.r75 - c.r25) / 50.0 * (temperature - 25.0)
    high = c.r25 + (c.r200 - c.r25) / 175.0 * (temperature - 25.0)
    return F.when(temperature <= 100.0, low).otherwise(high)


def heat_capacity(materials: Column) -> Column:
    """J / (m K) of an array of structs (type, mass); null if a type is unknown."""
    table = F.create_map(*[F.lit(x) for pair in HEAT_CAPACITY.items() for x in pair])
    return F.aggregate(materials, F.lit(0.0), lambda total, m: total + m["mass"] * F.try_element_at(table, m["type"]))


def heat_balance(c: Conductor, surface: Column, ambient: Column, wind: Column, angle: Column, elevation: Column, solar: Column) -> dict[str, Column]:
    """All terms and the current that holds the surface temperature."""
    parts = convection(c, surface, ambient, wind, angle, elevation)
    parts |= {"q_radiation": radiation(c, surface, ambient), "q_solar": measured_gain(c, solar), "resistance": resistance(c, surface)}
    net = parts["q_convection"] + parts["q_radiation"] - parts["q_solar"]
    return parts | {"current_a": F.when(net.isNotNull(), F.sqrt(F.greatest(net, F.lit(0.0)) / parts["resistance"]))}
