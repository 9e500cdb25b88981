"""Air-quality shapes derived from the given tables.

The texts run unchanged in Spark SQL and DuckDB: names in braces are tables or other shapes. Every
shape covers all rows of its table; nulls, negatives and bad values are written in by key so that the
edge branches of the operators run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SHAPES = {
    # station registry, one row per supplier
    "v_stations": """
SELECT s_suppkey AS station_id, s_name AS station_name,
       CASE s_suppkey % 6 WHEN 0 THEN 'Delhi' WHEN 1 THEN ' MUMBAI ' WHEN 2 THEN 'pune'
                          WHEN 3 THEN 'Kochi' WHEN 4 THEN 'Atlantis' END AS city,
       n_name AS state,
       CAST(6 AS DOUBLE)  + CAST((s_suppkey * 37) % 320 AS DOUBLE) / 10 AS latitude,
       CAST(68 AS DOUBLE) + CAST((s_suppkey * 53) % 300 AS DOUBLE) / 10 AS longitude,
       CASE WHEN s_suppkey % 3 = 0 THEN 'CPCB' WHEN s_suppkey % 3 = 1 THEN 'SPCB' ELSE 'SAFAR' END AS network,
       s_suppkey % 11 <> 0 AS is_active
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # the same registry as it arrives: text columns with gaps, repeats and bad coordinates
    "v_registry": """
SELECT station_id AS ordinal,
       CASE WHEN station_id % 23 = 0 THEN NULL ELSE CAST(station_id AS STRING) END AS station_id,
       CASE WHEN station_id % 7 = 0 THEN 'Shared' ELSE station_name END AS station_name,
       city, CASE WHEN station_id % 31 = 0 THEN '' ELSE state END AS state,
       CASE WHEN station_id % 17 = 0 THEN NULL WHEN station_id % 19 = 0 THEN '95.5'
            WHEN station_id % 29 = 0 THEN 'north' ELSE CAST(latitude AS STRING) END AS latitude,
       CASE WHEN station_id % 37 = 0 THEN NULL WHEN station_id % 41 = 0 THEN '-200.0'
            ELSE CAST(longitude AS STRING) END AS longitude
FROM {v_stations}""",
    # an official list that disagrees here and there
    "v_official": """
SELECT station_id AS ordinal,
       CASE WHEN station_id % 5 = 0 THEN 'X' || CAST(station_id AS STRING)
            WHEN station_id % 43 = 0 THEN '' ELSE CAST(station_id AS STRING) END AS station_id,
       upper(station_name) AS station_name, city,
       CASE WHEN station_id % 13 = 0 THEN 'Elsewhere' ELSE state END AS state,
       CAST(latitude + CASE WHEN station_id % 9 = 0 THEN 0.05 ELSE 0.001 END AS DOUBLE) AS latitude,
       CASE WHEN station_id % 47 = 0 THEN NULL ELSE longitude END AS longitude
FROM {v_stations}""",
    # long observations, one per event
    "v_obs_long": """
SELECT event_id AS ordinal, user_id AS station_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'view' THEN 'PM2.5' WHEN 'click' THEN 'PM10' WHEN 'signup' THEN 'NO2'
                       WHEN 'error' THEN 'SO2' ELSE 'OZONE' END AS pollutant,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 97 = 0 THEN -value ELSE value END AS value
FROM {events}""",
    # wide observations, one per line item
    "v_obs_wide": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS station_id, CAST(l_shipdate AS TIMESTAMP) AS ts,
       CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN -l_quantity ELSE l_quantity * 8 END AS pm25,
       l_extendedprice / 200 AS pm10, CAST(l_partkey % 600 AS DOUBLE) AS no2,
       CAST((l_orderkey * 13) % 1900 AS DOUBLE) AS so2, l_tax * 650 AS co,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST((l_orderkey * 7) % 1050 AS DOUBLE) END AS o3,
       l_discount * 100 - 5 AS u_wind, l_tax * 100 - 4 AS v_wind
FROM {lineitem}""",
    # raw wide table with exact copies, repeated station-times, negatives and bad coordinates
    "v_raw": """
SELECT o_orderkey AS ordinal, 'S' || CAST(o_custkey % 100 AS STRING) AS station, CAST(o_orderdate AS TIMESTAMP) AS ts,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN -o_totalprice / 1000
            ELSE o_totalprice / 1000 END AS pm25,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 700 + CASE WHEN o_orderkey % 101 = 0 THEN 5000 ELSE 0 END END AS pm10,
       CAST(o_orderkey % 80 AS DOUBLE) AS no2, CAST(7 AS DOUBLE) AS so2,
       CASE WHEN o_orderkey % 103 = 0 THEN 95.0 ELSE 6 + CAST(o_custkey % 100 AS DOUBLE) / 5 END AS latitude,
       CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE 68 + CAST(o_custkey % 100 AS DOUBLE) / 5 END AS longitude
FROM {orders}
UNION ALL
SELECT o_orderkey + 1000000000000 AS ordinal, 'S' || CAST(o_custkey % 100 AS STRING) AS station, CAST(o_orderdate AS TIMESTAMP) AS ts,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN -o_totalprice / 1000
            ELSE o_totalprice / 1000 END AS pm25,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 700 + CASE WHEN o_orderkey % 101 = 0 THEN 5000 ELSE 0 END END AS pm10,
       CAST(o_orderkey % 80 AS DOUBLE) AS no2, CAST(7 AS DOUBLE) AS so2,
       CASE WHEN o_orderkey % 103 = 0 THEN 95.0 ELSE 6 + CAST(o_custkey % 100 AS DOUBLE) / 5 END AS latitude,
       CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE 68 + CAST(o_custkey % 100 AS DOUBLE) / 5 END AS longitude
FROM {orders} WHERE o_orderstatus = 'P'""",
    # merged feature table with every kind of bad row; coordinates as text
    "v_merged": """
SELECT o_orderkey AS ordinal, 'S' || CAST(o_custkey AS STRING) AS station_id,
       'Station ' || CAST(o_custkey AS STRING) AS station_name, o_orderstatus AS city, o_orderpriority AS state,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'n/a' WHEN o_orderkey % 43 = 0 THEN '120.5'
            WHEN o_orderkey % 47 = 0 THEN '52.5' ELSE CAST(6 + CAST(o_custkey % 320 AS DOUBLE) / 10 AS STRING) END AS latitude,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(68 + CAST(o_custkey % 300 AS DOUBLE) / 10 AS STRING) END AS longitude,
       CASE WHEN o_orderkey % 31 = 0 THEN 'someday' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS "date",
       CASE WHEN o_orderkey % 29 = 0 THEN '25:00:00'
            ELSE lpad(CAST(o_orderkey % 3 AS STRING), 2, '0') || ':30:00' END AS "time",
       o_totalprice / 1000 AS pm25, o_totalprice / 700 AS pm10, CAST(o_orderkey % 80 AS DOUBLE) AS no2,
       CAST(o_orderkey % 40 AS DOUBLE) AS so2, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.5 END AS co,
       CAST(o_orderkey % 60 AS DOUBLE) AS o3,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 55 AS DOUBLE) END AS satellite_match_distance_km,
       CAST(o_orderkey % 53 AS DOUBLE) AS era5_match_distance_km,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS DOUBLE) END AS aqi
FROM {orders}""",
    # pixels of a satellite and weather grid: one per event, snapshots every six hours
    "v_pixels": """
SELECT event_id AS ordinal,
       CAST(CASE WHEN hour(ts) >= 18 THEN date_trunc('day', ts) + INTERVAL '18' HOUR
                 WHEN hour(ts) >= 12 THEN date_trunc('day', ts) + INTERVAL '12' HOUR
                 WHEN hour(ts) >= 6  THEN date_trunc('day', ts) + INTERVAL '6' HOUR
                 ELSE date_trunc('day', ts) END AS TIMESTAMP) AS "timestamp",
       CAST(6 AS DOUBLE)  + CAST((user_id * 37 % 1600) % 40 AS DOUBLE) * 0.8 AS latitude,
       CAST(68 AS DOUBLE) + CAST(((user_id * 37 % 1600) - (user_id * 37 % 1600) % 40) / 40 AS DOUBLE) * 0.75 AS longitude,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 100 END AS aod,
       CAST(event_id % 50 AS DOUBLE) / 10000 AS hcho, CAST(event_id % 30 AS DOUBLE) / 10000 AS no2_column,
       273 + value / 10 AS temperature, CAST(event_id % 90 AS DOUBLE) AS relative_humidity,
       CAST(event_id % 11 AS DOUBLE) - 5 AS u_wind, CAST(event_id % 7 AS DOUBLE) - 3 AS v_wind,
       CAST(event_id % 100 AS DOUBLE) / 100 AS qa_value, CAST(event_id % 4096 AS INT) AS qa_bits
FROM {events}""",
    "v_fires": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS detected_at, value AS frp,
       CASE WHEN event_id % 3 = 0 THEN 'low' WHEN event_id % 3 = 1 THEN 'nominal' ELSE 'high' END AS confidence,
       CAST(CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 6 = 1 THEN 1 WHEN event_id % 6 = 2 THEN 2
                 WHEN event_id % 6 = 3 THEN 108 WHEN event_id % 6 = 4 THEN 110 ELSE 104 END AS INT) AS confidence_code,
       CASE event_id % 5 WHEN 0 THEN 'forest' WHEN 1 THEN 'cropland' WHEN 2 THEN 'grassland'
                         WHEN 3 THEN 'shrubland' ELSE 'other' END AS land_cover
FROM {events}""",
    "v_hotspots": """
SELECT event_id AS hotspot_id, CAST(ts AS TIMESTAMP) AS detected_at, value / 10 AS column_density,
       CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
       CASE event_id % 4 WHEN 0 THEN 'industrial' WHEN 1 THEN 'biogenic'
                         WHEN 2 THEN 'biomass_burning' ELSE 'unknown' END AS source_type
FROM {events}""",
    "v_predictions": """
SELECT l_orderkey, l_linenumber, l_returnflag AS model, l_linenumber % 5 + 1 AS fold, l_extendedprice AS actual,
       l_quantity * 1500 AS predicted
FROM {lineitem}""",
    # numeric feature table: near-collinear, constant and all-null columns included
    "v_features": """
SELECT l_suppkey AS station_id, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_quantity * 8 END AS pm25,
       l_extendedprice / 200 AS pm10, CAST(l_partkey % 600 AS DOUBLE) AS no2,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST((l_orderkey * 13) % 1900 AS DOUBLE) END AS so2,
       273 + l_quantity + l_tax AS temperature, CAST(101325 AS DOUBLE) AS surface_pressure,
       CAST(NULL AS DOUBLE) AS aod, CASE WHEN l_partkey % 3 = 0 THEN 120.0 ELSE l_discount * 1000 END AS relative_humidity,
       l_shipdate >= CAST('1998-01-01' AS TIMESTAMP) AS weekend_flag, l_linestatus AS season,
       l_extendedprice / 250 + l_quantity AS aqi
FROM {lineitem}""",
    # a station's series with gaps
    "v_training": """
SELECT o_orderkey AS ordinal, CAST(o_orderdate AS TIMESTAMP) AS ts,
       CASE WHEN o_custkey % 19 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) * 8 END AS pm25,
       CAST(o_totalprice AS DOUBLE) / 2000 AS pm10, CAST(o_custkey % 600 AS DOUBLE) AS no2,
       CAST(o_orderkey * 13 % 1900 AS DOUBLE) AS so2, CAST(273 + o_custkey % 40 AS DOUBLE) AS temperature,
       CAST(o_orderkey % 11 AS DOUBLE) * 9 AS relative_humidity,
       CASE WHEN o_orderkey % 23 <> 0 THEN o_orderstatus END AS season,
       CAST(o_totalprice AS DOUBLE) / 2500 + CAST(o_orderkey % 50 AS DOUBLE) AS aqi
FROM {orders}""",
    "v_series": """
SELECT event_id AS ordinal, CASE WHEN event_id % 41 <> 0 THEN user_id END AS station_id,
       CASE WHEN event_id % 43 <> 0 THEN CAST(ts AS TIMESTAMP) END AS ts,
       CASE WHEN event_id % 3 = 0 OR user_id % 29 = 0 THEN NULL ELSE value END AS pm25,
       CASE WHEN event_id % 5 < 3 THEN NULL ELSE value * 2 END AS temperature
FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _closure(names: list[str]) -> list[str]:
    """Shapes needed for ``names``, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in SHAPES and name not in out:
            for inner in _NAME.findall(SHAPES[name]):
                visit(inner)
            out.append(name)

    for n in names:
        visit(n)
    return out


def oracle_text(body: str) -> str:
    """A full DuckDB query: shapes named in braces become CTEs."""
    shapes = _closure(_NAME.findall(body))
    plain = lambda text: _NAME.sub(r"\1", text).strip()
    body = plain(body)
    if not shapes:
        return body
    ctes = ",\n".join(f"{n} AS ({plain(SHAPES[n])})" for n in shapes)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Inputs:
    """Tables and shapes of one data folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SHAPES and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = SHAPES[name].replace('"', "`")
                needed = {n: getattr(self, n) for n in dict.fromkeys(_NAME.findall(text))}
                self._made[name] = self.spark.sql(text, **needed)
        return self._made[name]
