"""Angles, sexagesimal texts and Julian dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, col, short_number, trunc

_NUMBERS = r"^\s*([+-]?)(\d+(?:\.\d*)?)\s+(\d+(?:\.\d*)?)\s+(\d+(?:\.\d*)?)\s*$"


def hms_to_degrees(hours: Value, minutes: Value, seconds: Value) -> Column:
    return F.lit(15e0) * (col(hours) + col(minutes) / 60e0 + col(seconds) / 3600e0)


def dms_to_degrees(negative: Value, degrees: Value, minutes: Value, seconds: Value) -> Column:
    size = col(degrees) + col(minutes) / 60e0 + col(seconds) / 3600e0
    return F.when(col(negative), -size).otherwise(size)


def _part(text: Column, group: int) -> Column:
    return F.regexp_extract(text, _NUMBERS, group).try_cast("double")


def ra_text_to_degrees(text: Value) -> Column:
    """``"hh mm ss.ss"``; null where the text isn't three numbers. Seconds come from the third
    number (the original rereads the first), and a sign is not allowed."""
    text = col(text)
    return F.when(F.regexp_extract(text, _NUMBERS, 1) == "", hms_to_degrees(_part(text, 2), _part(text, 3), _part(text, 4)))


def dec_text_to_degrees(text: Value) -> Column:
    """``"[+-]dd mm ss.ss"``; the sign also holds for ``-0``; null where the text isn't that."""
    text = col(text)
    return dms_to_degrees(F.regexp_extract(text, _NUMBERS, 1) == "-", _part(text, 2), _part(text, 3), _part(text, 4))


def julian_days(timestamp: Value) -> Column:
    """With the time of day."""
    return F.unix_timestamp(col(timestamp)) / 86400e0 + 2440587.5


def julian_day_number(timestamp: Value) -> Column:
    """Whole days only: the time of day is cut off before adding."""
    return F.floor(F.unix_timestamp(col(timestamp)) / 86400e0) + F.lit(2440587.5)


def julian_epoch(days: Value) -> Column:
    """Julian days as a year with one decimal, halves to even."""
    return F.bround((col(days) - 2451545e0) / 365.25 + 2000e0, 1)


def _sexagesimal(value: Column) -> Column:
    whole = trunc(value)
    minutes = (value - whole) * 60e0
    seconds = (minutes - trunc(minutes)) * 60e0
    return F.concat_ws(" ", whole.cast("string"), trunc(minutes).cast("string"), short_number(seconds))


def dec_text(degrees: Value) -> Column:
    degrees = col(degrees)
    return F.concat(F.when(degrees < 0, "-").otherwise(""), _sexagesimal(F.abs(degrees)))


def ra_text(degrees: Value) -> Column:
    return _sexagesimal(col(degrees) / 15e0)


def position_texts(ra: Value, dec: Value) -> Column:
    return F.array(ra_text(ra), dec_text(dec))


def position_label(ra: Value, dec: Value, decimals: int) -> Column:
    """``[ra, dec]`` with rounded numbers, halves to even."""
    part = lambda v: short_number(F.bround(col(v), decimals), decimals)
    return F.concat(F.lit("["), part(ra), F.lit(", "), part(dec), F.lit("]"))


def positive_ra(ra: Value) -> Column:
    """Negative values wrap up; values of 360 and more stay as they are."""
    ra = col(ra)
    return F.when(ra < 0, F.pmod(ra, F.lit(360e0))).otherwise(ra)


def angle_difference(a: Value, b: Value) -> Column:
    """Smallest angle between two directions."""
    turn = F.abs(col(a) - col(b)) % 360e0
    return F.when(turn > 180, F.lit(360e0) - turn).otherwise(turn)
