"""Angles, distances and air density as column expressions."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
GRAVITY = 9.80665
KNOTS = 1.943844
FEET = 3.280840


def wrap(degrees: Column) -> Column:
    """Into [-180, 180); the half turn is -180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def _parts(value: Decimal) -> tuple[float, float]:
    """The nearest double, and what it lacks."""
    return float(value), float(value - Decimal(float(value)))


def _angles(n: int = 64) -> list[tuple[float, float]]:
    """The arc tangents of 0, 1/n, .., 1 in two doubles each."""
    with localcontext() as c:
        c.prec = 40

        def atan(v: Decimal) -> Decimal:
            for _ in range(3):
                v = v / (1 + (1 + v * v).sqrt())
            return 8 * sum(((-1) ** k * v ** (2 * k + 1) / (2 * k + 1) for k in range(25)), Decimal(0))

        return [_parts(atan(Decimal(k) / n)) for k in range(n + 1)]


ANGLES = _angles()
#: Half a turn and a quarter in two doubles each.
HALF, QUARTER = [(4 * f * ANGLES[64][0], 4 * f * ANGLES[64][1]) for f in (1, 0.5)]


def _sides(y: Column, x: Column) -> tuple[Column, Column]:
    return F.greatest(F.abs(y), F.abs(x)), F.least(F.abs(y), F.abs(x))


def nearest_64th(y: Column, x: Column) -> Column:
    """The ratio of the smaller side to the larger, in whole 64ths."""
    big, small = _sides(y, x)
    return F.rint(F.try_divide(small, big) * 64)


def beyond_64th(y: Column, x: Column, j: Column) -> Column:
    """The angle from that of ``j`` 64ths to that of the sides."""
    big, small = _sides(y, x)
    upper = big.cast("float").cast("double")
    return F.atan(((small * 64 - j * upper) - j * (big - upper)) / (big * 64 + small * j))


def _tabled(k: int, y: Column, x: Column, j: Column) -> Column:
    """The near or far part of the angle of ``j`` 64ths, with the sign that it has in this eighth."""
    value = F.get(F.array(*[F.lit(p[k]) for p in ANGLES]), j.cast("int"))
    return F.when((F.abs(y) > F.abs(x)) != (x < 0), -value).otherwise(value)


def near_angle(y: Column, x: Column, j: Column) -> Column:
    return _tabled(0, y, x, j)


def far_angle(y: Column, x: Column, j: Column) -> Column:
    """What the tabled angle lacks, and the angle from there to the sides."""
    rest = beyond_64th(y, x, j)
    return _tabled(1, y, x, j) + F.when((F.abs(y) > F.abs(x)) != (x < 0), -rest).otherwise(rest)


def atan2(y: Column, x: Column, near: Column | None = None, far: Column | None = None) -> Column:
    """The angle rounded to the nearest double (all but one in two hundred).

    The JVM's own may be one place off, and other engines' are nearest: a turn
    that lies at half a unit of its rounding would then round otherwise.  The
    ratio's nearest 64th has a tabled angle; the rest is small, so its error is.
    Both parts may be given as columns, which keeps the compiled methods short.
    """
    near = near_angle(y, x, nearest_64th(y, x)) if near is None else near
    far = far_angle(y, x, nearest_64th(y, x)) if far is None else far
    steep, back = F.abs(y) > F.abs(x), x < 0
    whole = lambda k: F.when(steep, QUARTER[k]).when(back, HALF[k]).otherwise(0.0)
    total = whole(0) + near
    # a quarter and half are larger than the tabled angle, so this is all that the sum lost
    angle = total + ((near - (total - whole(0))) + (whole(1) + far))
    return F.when(_sides(y, x)[0].between(1e-30, 1e30), F.when(y < 0, -angle).otherwise(angle)).otherwise(F.atan2(y, x))


def compass(east: Column, north: Column, near: Column | None = None, far: Column | None = None) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(atan2(east, north, near, far)), F.lit(360.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    a = half(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(F.radians(lon2 - lon1))
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_M)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return compass(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def sigma(height_m: Column) -> Column:
    """ISA density ratio, at least 0.3."""
    base = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.25577e-5) * height_m)
    return F.greatest(F.lit(0.3), F.pow(base, F.lit(4.256)))
