"""Distances, boxes and grid arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aeroframe import values as V


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column,
                 radius: float = V.EARTH_RADIUS_MATCH_KM) -> Column:
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def in_world(lat: Column, lon: Column) -> Column:
    return in_box(lat, lon, (-90.0, 90.0, -180.0, 180.0))


def tenth_degree(x: Column) -> Column:
    """Coordinate rounded to one decimal, half to even."""
    return F.rint(x * 10) / 10
