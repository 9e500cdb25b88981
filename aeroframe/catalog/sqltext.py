"""Pieces of DuckDB text shared by the counterpart queries."""

from __future__ import annotations

from aeroframe import values as V


def cut_sql(pollutant: str, x: str) -> str:
    cut = f"floor(round({x}, 6) * 10) / 10" if pollutant in V.ONE_DECIMAL_POLLUTANTS else f"floor(round({x}, 6))"
    return f"(CASE WHEN {x} >= 0 THEN {cut} END)"


def index_sql(pollutant: str, x: str, rounded: bool = True) -> str:
    """Sub-index by explicit closed ranges."""
    c = cut_sql(pollutant, x)
    rows = V.BREAKPOINTS[pollutant]
    arms = " ".join(
        f"WHEN {c} BETWEEN {lo} AND {hi} THEN CAST({ihi - ilo} AS DOUBLE) / CAST({hi - lo!r} AS DOUBLE) * ({c} - {lo}) + {ilo}"
        for lo, hi, ilo, ihi in rows)
    raw = f"CASE WHEN {c} > {rows[-1][1]} THEN CAST(500 AS DOUBLE) {arms} END"
    return f"CAST(round_even({raw}, 0) AS INTEGER)" if rounded else f"({raw})"


def category_sql(x: str) -> str:
    arms = " ".join(f"WHEN {x} <= {b} THEN '{n}'" for b, n in V.AQI_CATEGORIES)
    return f"CASE WHEN {x} IS NULL THEN NULL {arms} ELSE '{V.AQI_WORST}' END"


def haversine_sql(lat_a: str, lon_a: str, lat_b: str, lon_b: str, radius: float = V.EARTH_RADIUS_MATCH_KM) -> str:
    return (f"(2 * {radius} * asin(least(1.0, sqrt(pow(sin(radians({lat_b} - {lat_a}) / 2), 2) + cos(radians({lat_a})) * "
            f"cos(radians({lat_b})) * pow(sin(radians({lon_b} - {lon_a}) / 2), 2)))))")


def dominant_sql(columns: dict[str, str], top: str) -> str:
    """Lexicographically first pollutant whose sub-index column equals ``top``."""
    arms = " ".join(f"WHEN {c} = {top} THEN '{p}'" for p, c in sorted(columns.items()))
    return f"CASE {arms} END"


# station-day table used by several queries: first non-null value per pollutant, then the index
_DAY = {"PM2.5": "pm25", "PM10": "pm10", "NO2": "no2", "SO2": "so2", "O3": "o3"}

DAY_CTES = """wide AS (
  SELECT station_id, CAST(ts AS DATE) AS obs_date, """ + ", ".join(
    f"min_by(value, ordinal) FILTER (WHERE pollutant IN ({', '.join(repr(n) for n in ([p, 'OZONE'] if p == 'O3' else [p]))}) AND value IS NOT NULL) AS {c}"
    for p, c in _DAY.items()) + """
  FROM {v_obs_long} WHERE station_id IS NOT NULL AND ts IS NOT NULL GROUP BY station_id, CAST(ts AS DATE)),
parts AS (SELECT *, """ + ", ".join(f"{index_sql(p, c)} AS {c}_index" for p, c in _DAY.items()) + """ FROM wide),
top AS (SELECT *, greatest(""" + ", ".join(f"{c}_index" for c in _DAY.values()) + """) AS aqi FROM parts),
day_index AS (SELECT *, """ + dominant_sql({p: f"{c}_index" for p, c in _DAY.items()}, "aqi") + """ AS dominant,
  """ + category_sql("aqi") + """ AS category FROM top)"""
