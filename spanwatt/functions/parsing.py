"""Tower ids, times and numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwatt.config import TIME_ZONE


def number(text: Column) -> Column:
    """A double, or null where the text is no number or not a number; infinities stay."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def _integer_text(text: Column) -> Column:
    value = text.try_cast("double")
    whole = (value >= 0) & (value < 1e15) & (value == F.floor(value))
    return F.when(whole, F.floor(value).cast("long").cast("string"))


def tower_id(text: Column) -> Column:
    """Strict: digits before a final 号, or digits (leading zeros stay), or a whole number."""
    text = F.trim(text.cast("string"))
    tail = F.regexp_extract(text, r"(?<![\d.])(\d+)\s*号$", 1)
    return F.when(tail != "", tail).when(text.rlike(r"^\d+$"), text).otherwise(_integer_text(text))


def tower_number(text: Column) -> Column:
    """Lenient, for positions: a whole number, else the first run of digits."""
    text = F.trim(text.cast("string"))
    return F.coalesce(_integer_text(text), F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))).try_cast("long")


def coordinate_tower_id(text: Column) -> Column:
    """Names of coordinate tables: digits before 号, else the last digits, else a whole number."""
    text = F.trim(text.cast("string"))
    named = F.regexp_extract(text, r"(?<![\d.])(\d+)\s*号$", 1)
    last = F.regexp_extract(text, r"(?<![\d.])(\d+)\s*$", 1)
    return F.when(named != "", named).when(last != "", last).otherwise(_integer_text(text))


def date_and_time(date: Column, time: Column) -> Column:
    """A wall-clock time (timestamp_ntz) out of a date and HH:MM, HH:MM:SS or a full date and
    time, of which only the time counts."""
    clock = F.trim(time.cast("string"))
    clock = F.regexp_extract(clock, r"(\d{1,2}:\d{2}(?::\d{2})?)\s*$", 1)
    day = F.regexp_replace(F.substring_index(F.trim(date.cast("string")), " ", 1), "/", "-")
    joined = F.concat_ws(" ", day, F.when(F.length(clock) - F.length(F.replace(clock, F.lit(":"), F.lit(""))) == 1, F.concat(clock, F.lit(":00"))).otherwise(clock))
    return F.when(clock != "", F.try_to_timestamp(joined, F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz"))


def instant(text: Column, zone: str = TIME_ZONE) -> Column:
    """The UTC wall clock (timestamp_ntz) of a time with an offset, or of one in ``zone``; null
    for a local time that the zone skips or has twice.  Needs a session in UTC."""
    text = F.trim(text.cast("string"))
    offset = text.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    local = text.try_cast("timestamp_ntz").cast("timestamp")
    utc = F.to_utc_timestamp(local, zone)
    there = F.from_utc_timestamp(utc, zone) == local
    twice = F.lit(False)
    for shift in ("1", "-1"):
        other = utc + F.expr(f"interval '{shift}' hour")
        twice |= F.from_utc_timestamp(other, zone) == local
    return F.when(offset, text.try_cast("timestamp")).otherwise(F.when(there & ~twice, utc)).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp_ntz since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def from_micros(value: Column) -> Column:
    """The timestamp_ntz of so many microseconds; needs a session in UTC."""
    return F.timestamp_micros(value).cast("timestamp_ntz")
