"""Bands for legends and marker sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aeroframe import values as V


def banded(x: Column, bands: list[tuple[float, str]], worst: str) -> Column:
    """Name of the first band whose upper limit lies above the value."""
    chain = None
    for limit, name in bands:
        chain = F.when(x < limit, name) if chain is None else chain.when(x < limit, name)
    return chain.when(x.isNotNull(), worst)


def fire_map_band(frp: Column) -> Column:
    return banded(frp, V.FIRE_MAP_BANDS, V.FIRE_MAP_WORST)


def fire_legend_band(frp: Column) -> Column:
    return banded(frp, V.FIRE_LEGEND_BANDS, V.FIRE_LEGEND_WORST)


def hcho_legend_band(density: Column) -> Column:
    return banded(density, V.HCHO_LEGEND_BANDS, V.HCHO_LEGEND_WORST)


def marker_radius(frp: Column) -> Column:
    return F.least(F.greatest(frp / 15.0, F.lit(6.0)), F.lit(22.0))
