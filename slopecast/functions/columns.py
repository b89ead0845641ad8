"""Small column expressions shared by the jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slopecast import fixed

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def rounded(c: Column, digits: int = 4) -> Column:
    """Round half up. Noise below 1e-8, as left by the order of a sum, is shed first, so that a
    tie falls the same way whatever the plan or engine. Values from 1e14 on, where a double has
    hardly a digit to shed, and infinities and NaN stay as they are."""
    scale = float(10**digits)
    return F.when(F.abs(c) < 1e14, F.floor(F.rint(c * 1e8) / 1e8 * scale + 0.5) / F.lit(scale)).otherwise(c.cast("double"))


def clamp(c: Column, low: float, high: float) -> Column:
    """Limit a non-null value to [low, high]."""
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a 6371 km sphere."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2.0 * fixed.EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1.0 - a)))


def metres_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance with 111 320 m per degree and the longitude scaled at lat1."""
    dy = (lat2 - lat1) * fixed.METRES_PER_DEGREE
    dx = (lon2 - lon1) * fixed.METRES_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def segment_metres(lat: Column, lon: Column, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Planar distance in metres from a point to a segment, plane centred on the point."""
    kx = fixed.METRES_PER_DEGREE * F.cos(F.radians(lat))
    ky = F.lit(fixed.METRES_PER_DEGREE)
    ax, ay = (x1 - lon) * kx, (y1 - lat) * ky
    bx, by = (x2 - lon) * kx, (y2 - lat) * ky
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, clamp(-(ax * dx + ay * dy) / length2, 0.0, 1.0)).otherwise(F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py)


def normal_name(c: Column) -> Column:
    """Upper case, trimmed, inner white space collapsed; NULL stays NULL."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


def blank_to_null(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def number_or_null(c: Column) -> Column:
    """Text to double; percent signs and thousands commas are dropped, junk is NULL."""
    plain = F.trim(F.regexp_replace(c, "[%,]", ""))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def literal_map(values: dict) -> Column:
    """A constant map."""

    def text(v) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)

    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in values.items()) + ")")


def tile_name(lat: Column, lon: Column, step: int = 1) -> Column:
    """Name of the south-west corner of the step-degree tile, e.g. N25E091."""
    south = F.floor(lat / step) * step
    west = F.floor(lon / step) * step
    return F.concat(
        F.when(south >= 0, "N").otherwise("S"), F.lpad(F.abs(south).cast("string"), 2, "0"),
        F.when(west >= 0, "E").otherwise("W"), F.lpad(F.abs(west).cast("string"), 3, "0"),
    )


def degrees_for_km(km: float) -> float:
    """Degrees of latitude that are a little more than km."""
    return 1.001 * math.degrees(km / fixed.EARTH_RADIUS_KM)
