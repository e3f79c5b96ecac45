"""Distances and angles in plain column arithmetic, on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate is missing."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    dlat, dlon = half(lat1, lat2), half(lon1, lon2)
    h = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def polyline_length_m(points: Column) -> Column:
    """Sum over neighbouring points of an array of (lat, lon) structs."""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
                       F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
                       lambda p, q: distance_m(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(pairs, F.lit(0.0), lambda total, d: total + d)


def angle_degrees(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle a-b-c at b, folded into [0, 180)."""
    turn = F.degrees(F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx))
    return F.pmod(F.when(turn < 0, turn + 360).otherwise(turn), F.lit(180.0))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
