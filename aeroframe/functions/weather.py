"""Wind from its components."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column, convention: str = "towards") -> Column:
    """Bearing in degrees. ``towards``: where the air moves to; ``from``: where it comes from."""
    turn = {"towards": 360.0, "from": 540.0}[convention]
    return F.pmod(F.degrees(F.atan2(u, v)) + F.lit(turn), F.lit(360.0))
