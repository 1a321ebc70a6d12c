"""Scalar expressions: missing values, clipping, half-even rounding, angles, rotation, projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts))


def finite(x: str | Column) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clean(x: str | Column) -> Column:
    """NaN and infinities become null, so aggregates skip them."""
    return F.when(finite(x), col(x))


def to_double(text: str | Column) -> Column:
    """Text as a number; null where it is blank or none."""
    return clean(F.trim(col(text)).try_cast("double"))


def tri_state(text: str | Column) -> Column:
    """true, false or null of a free-text flag."""
    t = F.lower(F.trim(col(text)))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def clip(x: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def half_even(x: str | Column, digits: int = 0) -> Column:
    return F.bround(col(x), digits)


def half_away(x: str | Column, digits: int = 0) -> Column:
    """x times a power of ten, rounded half away from zero and taken back, as C's round does on doubles; a negative zero stays one."""
    x, scale = col(x), float(10**digits)
    return F.signum(x) * F.round(F.abs(x) * scale) / scale


def over(x: str | Column, y: str | Column) -> Column:
    """x / y of doubles by IEEE 754: by zero it is an infinity, or NaN, never an error."""
    x, y = col(x), col(y)
    return F.when(y == 0, x * F.lit(float("inf"))).otherwise(F.try_divide(x, y))


def wrap_angle(a: str | Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(col(a) + math.pi, F.lit(2 * math.pi)) - math.pi


def into_frame(x, y, x0, y0, yaw) -> tuple[Column, Column]:
    """Coordinates in a frame at (x0, y0) turned by yaw."""
    dx, dy, c, s = col(x) - col(x0), col(y) - col(y0), F.cos(col(yaw)), F.sin(col(yaw))
    return dx * c + dy * s, dy * c - dx * s


def out_of_frame(u, v, x0, y0, yaw) -> tuple[Column, Column]:
    c, s = F.cos(col(yaw)), F.sin(col(yaw))
    return col(x0) + col(u) * c - col(v) * s, col(y0) + col(u) * s + col(v) * c


def norm(*parts: str | Column) -> Column:
    total = None
    for p in parts:
        total = col(p) * col(p) if total is None else total + col(p) * col(p)
    return F.sqrt(total)


def utm(lat: str | Column, lon: str | Column, zone: int = 31) -> tuple[Column, Column]:
    """Easting and northing in metres on WGS 84 (northern hemisphere), by the usual series in the third flattening."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996  # fixed values of the projection
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - F.lit(6.0 * zone - 183.0))
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + k0 * big_a * x, k0 * big_a * y
