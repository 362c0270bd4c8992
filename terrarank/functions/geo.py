"""Great-circle distance, unit vectors and bearings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

EARTH_RADIUS_MILES = 3958.7613
KM_PER_MILE = 1.609344


def haversine_miles(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def unit_vector(lat: Column | str, lon: Column | str) -> tuple[Column, Column, Column]:
    la, lo = F.radians(col(lat)), F.radians(col(lon))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def chord(miles: float) -> float:
    """Straight-line length on the unit sphere of a great-circle distance."""
    import math

    return 2 * math.sin(min(math.pi / 2, miles / EARTH_RADIUS_MILES / 2))


def region_of(lat: Column | str, lon: Column | str, ref_lat: float, ref_lon: float, radius_miles: float) -> Column:
    """``Downtown`` inside the radius, else the compass quarter seen from the reference point."""
    import math

    lat, lon = col(lat), col(lon)
    dy = lat - ref_lat
    dx = (lon - ref_lon) * math.cos(math.radians(ref_lat))
    bearing = F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))
    quarter = F.floor(F.pmod(bearing + 45, F.lit(360.0)) / 90)
    word = F.element_at(F.array(*[F.lit(w) for w in ("North", "East", "South", "West")]), quarter.cast("int") + 1)
    return F.when(haversine_miles(lat, lon, F.lit(ref_lat), F.lit(ref_lon)) <= radius_miles, "Downtown").otherwise(word)
