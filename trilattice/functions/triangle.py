"""Column expressions of one triangle with the corners (x0, y0), (x1, y1), (x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corner(i: int) -> tuple[Column, Column]:
    return F.col(f"x{i}"), F.col(f"y{i}")


def signed_area(a=None, b=None, c=None) -> Column:
    """Half the cross product; negative when the corners run clockwise."""
    (x0, y0), (x1, y1), (x2, y2) = a or corner(0), b or corner(1), c or corner(2)
    return ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2


def distance(a, b) -> Column:
    """Plain square root of squares, which every engine rounds alike."""
    (xa, ya), (xb, yb) = a, b
    return F.sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya))


def clipped(cosine: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def angle(opposite: Column, p: Column, q: Column) -> Column:
    """Degrees between sides p and q by the law of cosines; 0 where a side has no length."""
    cosine = F.when(p * q > 0, (p * p + q * q - opposite * opposite) / (2 * p * q)).otherwise(F.lit(1.0))
    return F.degrees(F.acos(clipped(cosine)))


def alpha(area: Column, a: Column, b: Column, c: Column) -> Column:
    """1 for an equilateral triangle, 0 for a flat one."""
    total = a * a + b * b + c * c
    return F.lit(4.0) * F.sqrt(F.lit(3.0)) * F.abs(area) / F.when(total == 0, F.lit(1.0)).otherwise(total)


def penalty(alpha_: Column, low: Column, high: Column, least_alpha: float = 0.7, least_angle: float = 30.0, most_angle: float = 130.0) -> Column:
    """Squared shortfalls of alpha, and of the extreme angles in tens of degrees."""
    over = lambda c: F.greatest(F.lit(0.0), c)
    return over(F.lit(least_alpha) - alpha_) * over(F.lit(least_alpha) - alpha_) + over(F.lit(least_angle) - low) * over(F.lit(least_angle) - low) / 100 + over(high - most_angle) * over(high - most_angle) / 100


def haversine(lon0: Column, lat0: Column, lon1: Column, lat1: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle metres between degrees.

    Degrees are subtracted before they become radians, and squares taken before they are multiplied: latitudes turns apart
    then round as in SQL, so that the same one of them is nearest.
    """
    s, t = F.sin(F.radians(lat1 - lat0) / 2), F.sin(F.radians(lon1 - lon0) / 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(s * s + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * (t * t))))


def courant_size(depth: Column, dt: float, courant: float, nu: float = 2.0, g: float = 9.81, low: float | None = None, high: float | None = None) -> Column:
    """Element size at which a gravity wave with a particle speed of amplitude nu keeps the Courant number at dt seconds."""
    h = F.greatest(depth, F.lit(1.0))
    speed = F.when(h > nu, F.lit(nu) * F.sqrt(F.lit(g) / h) + F.sqrt(F.lit(g) * h)).otherwise(F.lit(2.0) * F.sqrt(F.lit(g * nu)))
    size = speed * dt / courant
    size = F.greatest(size, F.lit(low)) if low is not None else size
    return F.least(size, F.lit(high)) if high is not None else size


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60 of a longitude in degrees."""
    return F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180) / 6) + 1).cast("int")))
