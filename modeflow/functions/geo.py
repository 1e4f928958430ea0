"""Spherical geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres of a degree of latitude on that sphere.
DEGREE_M = EARTH_M * 3.141592653589793 / 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees; null where a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    held = F.when(a > 1, 1.0).when(a < 0, 0.0).otherwise(a)  # least() would pass over a null
    return 2 * EARTH_M * F.asin(F.sqrt(held))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial direction from the first point to the second, -180 to 180 degrees."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def turn(before: Column, after: Column) -> Column:
    """The change between two directions, folded to 0 to 180 degrees."""
    d = F.abs(after - before)
    return F.when(d > 180, 360 - d).otherwise(d)
