"""Analysis grid, gridded products and their merge."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeroframe import values as V
from aeroframe.functions.geo import tenth_degree


def product(alias: str) -> dict | None:
    """Collection, bands and resolution of a satellite or weather product; None when unknown."""
    found = V.PRODUCTS.get(alias.upper())
    return None if found is None else dict(zip(("collection", "bands", "metres"), found))


def grid_shape(box: tuple[float, float, float, float], resolution_km: float = V.GRID_RESOLUTION_KM):
    """(lat step, lon step, rows, columns) of a grid over (west, south, east, north)."""
    west, south, east, north = box
    lat_step = resolution_km / V.KM_PER_DEGREE
    lon_step = resolution_km / (V.KM_PER_DEGREE * math.cos(math.radians((south + north) / 2)))
    fit = lambda extent, step: max(0, math.floor(extent / step + 0.5 + 1e-9))
    return lat_step, lon_step, fit(north - south, lat_step), fit(east - west, lon_step)


def analysis_grid(spark: SparkSession, box: tuple[float, float, float, float],
                  resolution_km: float = V.GRID_RESOLUTION_KM, corners: bool = True) -> DataFrame:
    """Cell centres row by row from the south-west, ids and closed corner rings."""
    west, south, _, _ = box
    lat_step, lon_step, n_lat, n_lon = grid_shape(box, resolution_km)
    cells = spark.range(n_lat * n_lon).select(
        "id", F.floor(F.col("id") / n_lon).alias("row"), (F.col("id") % max(n_lon, 1)).alias("col"))
    lat = F.round(F.lit(south) + F.lit(lat_step) * (F.col("row") + 0.5), 5)
    lon = F.round(F.lit(west) + F.lit(lon_step) * (F.col("col") + 0.5), 5)
    out = cells.select(
        F.format_string("GRID_%06d", "id").alias("grid_id"), F.format_string("CELL_%06d", "id").alias("cell_id"),
        "row", "col", lat.alias("latitude"), lon.alias("longitude"))
    if not corners:
        return out
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    ring = F.array(*[F.array(F.col("longitude") + sx * lon_step / 2, F.col("latitude") + sy * lat_step / 2)
                     for sx, sy in signs])
    return out.withColumn("corners", ring)


def cell_of(lat: Column, lon: Column, box: tuple[float, float, float, float],
            resolution_km: float = V.GRID_RESOLUTION_KM) -> tuple[Column, Column]:
    """Row and column of the cell a point falls into; null outside the grid."""
    west, south, _, _ = box
    lat_step, lon_step, n_lat, n_lon = grid_shape(box, resolution_km)
    row, col = F.floor((lat - south) / lat_step), F.floor((lon - west) / lon_step)
    inside = row.between(0, n_lat - 1) & col.between(0, n_lon - 1)
    return F.when(inside, row), F.when(inside, col)


def band_mean_grid(pixels: DataFrame, band: str, start: Column, end: Column, ts: str = "ts",
                   lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Mean of a band per tenth-degree cell within [start, end), stamped with the start."""
    kept = pixels.where((F.col(ts) >= start) & (F.col(ts) < end))
    return kept.groupBy(tenth_degree(F.col(lat)).alias("latitude"), tenth_degree(F.col(lon)).alias("longitude")).agg(
        F.avg(band).alias(band)).select(start.alias("timestamp"), "latitude", "longitude", band)


def merge_products(products: Sequence[DataFrame], bands: Sequence[str]) -> DataFrame:
    """All products on (timestamp, latitude, longitude) rounded to a tenth; absent bands are null.

    One union and one aggregation stand for a chain of full outer joins. Pixels of a product that round to
    one key are averaged, so no value is lost and pixels of different products never multiply.
    """
    stacked = None
    for p in products:
        part = p.select(
            "timestamp", tenth_degree(F.col("latitude")).alias("latitude"), tenth_degree(F.col("longitude")).alias("longitude"),
            *[F.col(b) if b in p.columns else F.lit(None).cast("double").alias(b) for b in bands])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("timestamp", "latitude", "longitude").agg(*[F.avg(b).alias(b) for b in bands])


def daily_cell_means(hourly: DataFrame, bands: Sequence[str], cell: Sequence[str], ts: str = "ts",
                     sum_bands: Sequence[str] = ()) -> DataFrame:
    """Hourly to daily per cell: mean of every band, or the sum for the bands named."""
    day = F.date_trunc("day", F.col(ts))
    return hourly.groupBy(*cell, day.alias("day_ts")).agg(
        *[(F.sum(b) if b in sum_bands else F.avg(b)).alias(b) for b in bands])


def placeholder_rows(stations_times: DataFrame, features: Sequence[str], ts: str = "ts") -> DataFrame:
    """Stand-in grid when no grid exists: every station place and time that occurs, features null.

    Only combinations that occur are produced; nothing ever looks up another one.
    """
    places = stations_times.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return places.select(F.col(ts).alias("timestamp"), "latitude", "longitude").distinct().select(
        "*", *[F.lit(None).cast("double").alias(f) for f in features])
