"""Times, durations and units as column expressions; ``system`` is ``imperial`` or ``metric``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import FEET, KNOTS


def _clock(t: Column) -> tuple[Column, Column, Column]:
    s = F.pmod(F.floor(t), F.lit(86400))
    return F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))


def hms(t: Column) -> Column:
    return F.when(t.isNotNull(), F.format_string("%02d:%02d:%02d", *_clock(t)))


def zulu(t: Column) -> Column:
    return F.concat(hms(t), F.lit("Z"))


def hm(t: Column) -> Column:
    return F.when(t.isNotNull(), F.format_string("%02d:%02d", *_clock(t)[:2]))


def duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("long")
    h, m, r = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def instant(date: Column, t: Column) -> Column:
    """ISO-8601 UTC of a ``yyyy-MM-dd`` date and seconds since its midnight; null without a usable date."""
    start = F.unix_seconds(F.try_to_timestamp(F.concat(date, F.lit(" 00:00:00 UTC")), F.lit("yyyy-MM-dd HH:mm:ss z")))
    at = F.timestamp_seconds(start + F.floor(t))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def height(metres: Column, system: str = "imperial") -> Column:
    return metres * FEET if system == "imperial" else metres


def climb_rate(ms: Column, system: str = "imperial") -> Column:
    return ms * KNOTS if system == "imperial" else ms


def airspeed(ms: Column, system: str = "imperial") -> Column:
    return ms * KNOTS if system == "imperial" else ms * 3.6


def wind_speed(ms: Column) -> Column:
    """Knots in both systems."""
    return ms * KNOTS


def distance(metres: Column) -> Column:
    """Kilometres in both systems."""
    return metres / 1000


def to_fixed(x: Column, places: int) -> Column:
    """Rounded to ``places`` decimals by the binary value, halves away from zero.

    ``round`` goes by the shortest decimal form, so a value just below a half
    (2.675 is 2.67499...) would go up.  Such values are the doubles next to an
    odd number of fives; the exact error of the scaling (two-product by
    splitting) tells on which side of the half they lie.
    """
    a, scale = F.abs(x.cast("double")), float(10 ** (places + 1))
    product = a * scale
    half = F.rint(product)
    split = a * 134217729.0
    high = split - (split - a)
    error = (high * scale - product) + (a - high) * scale
    below = (half / scale == a) & (F.pmod(half, F.lit(10.0)) == 5.0) & ((product - half) + error < 0)
    return F.signum(x) * F.when(below, F.floor(half / 10.0) / float(10**places)).otherwise(F.round(a, places))
