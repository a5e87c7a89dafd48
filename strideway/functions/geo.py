"""Distances on the earth and on local planes, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius, and metres for a degree on the plane that records are matched on.
EARTH_RADIUS_M = 6_371_000.0
PLANE_M_PER_LAT, PLANE_M_PER_LON = 111_320.0, 91_000.0
DEGREE_M = EARTH_RADIUS_M * 3.141592653589793 / 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x, y = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(x * x + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * y * y))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y, x = (lat2 - lat1) * PLANE_M_PER_LAT, (lon2 - lon1) * PLANE_M_PER_LON
    return F.sqrt(x * x + y * y)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def swapped(point: Column) -> Column:
    """A point's struct with the axes in the other order, as GeoJSON has them."""
    return F.struct(point.getField("lon").alias("lon"), point.getField("lat").alias("lat"))


def rounded(x: Column, places: int = 0) -> Column:
    """To so many places, halves up; never through round(), whose halves differ between engines."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def rounded_away(x: Column, places: int = 0) -> Column:
    """Halves away from zero, and no negative zero."""
    f = float(10**places)
    return F.when(x < 0, -(F.floor(-x * f + 0.5) / f)).otherwise(F.floor(x * f + 0.5) / f) + 0.0
