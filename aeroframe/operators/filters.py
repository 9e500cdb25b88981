"""Row filters and the service-style lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from aeroframe import values as V
from aeroframe.functions import geo, masks


def any_negative(df: DataFrame, columns: Sequence[str]) -> Column:
    present = [c for c in columns if c in df.columns]
    if not present:
        return F.lit(False)
    return F.coalesce(reduce(or_, [F.coalesce(F.col(c).try_cast("double") < 0, F.lit(False)) for c in present]),
                      F.lit(False))


def drop_negative_rows(df: DataFrame, columns: Sequence[str] = tuple(V.CLEANED_COLUMNS)) -> DataFrame:
    return df.where(~any_negative(df, columns))


def invalid_coordinates(lat: Column, lon: Column) -> Column:
    """Outside the world; null or text that is no number does not count."""
    lat, lon = lat.try_cast("double"), lon.try_cast("double")
    off = (lat < -90) | (lat > 90) | (lon < -180) | (lon > 180)
    return F.coalesce(off, F.lit(False))


def only_stations(df: DataFrame, wanted: DataFrame | None, key: str = "station_id") -> DataFrame:
    """Rows of the listed stations; no list keeps everything."""
    return df if wanted is None else df.join(wanted.select(key).distinct(), key, "left_semi")


def absent_stations(df: DataFrame, wanted: DataFrame, key: str = "station_id") -> DataFrame:
    """Requested stations that never appear."""
    return wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def in_window(df: DataFrame, ts: str, start: Column, end: Column, bands: Sequence[str],
              box: tuple[float, float, float, float] | None = None,
              lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Half-open date filter, optional box and band projection."""
    kept = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    if box:
        kept = kept.where(geo.in_box(F.col(lat), F.col(lon), box))
    return kept.select(ts, lat, lon, *bands)


def day_window(day: Column, days: int = 1) -> tuple[Column, Column]:
    """Half-open window of ``days`` around a date, the date itself included."""
    return F.date_sub(day, days).cast("timestamp"), F.date_add(day, days + 1).cast("timestamp")


def fires(df: DataFrame, min_frp: float = 10.0, reference: Column | None = None, hours: int | None = None,
          level: str = "low") -> DataFrame:
    kept = df.where(F.col("frp") >= min_frp)
    if hours is not None:
        kept = kept.where((F.col("detected_at") > reference - F.make_interval(hours=F.lit(hours)))
                          & (F.col("detected_at") <= reference))
    return kept.where(masks.fire_confidence_ok(F.col("confidence_code"), level)) if level != "low" else kept


def hotspots(df: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    return df.where(F.col("confidence") >= min_confidence)


def stations(df: DataFrame, state: str | None = None, network: str | None = None,
             active_only: bool = True, limit: int | None = None) -> DataFrame:
    """Registry lookup: all matches, or the first ``limit`` by id where a page is asked for."""
    kept = df.where("is_active") if active_only else df
    if state:
        kept = kept.where(F.lower("state").contains(state.lower()))
    if network:
        kept = kept.where(F.lower("network") == network.lower())
    return kept if limit is None else kept.orderBy("station_id").limit(limit)
