"""Column expressions: index, distances, dates, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroframe import values as V
from aeroframe.catalog.registry import query, r, sql_r
from aeroframe.catalog.sqltext import (DAY_CTES, category_sql, cut_sql, dominant_sql, haversine_sql, index_sql)
from aeroframe.functions import aqi as ax, bands, geo, text, time as tm, weather
from aeroframe.operators import grids, serve
from aeroframe.plans import flows

_WIDE = {"PM2.5": "pm25", "PM10": "pm10", "NO2": "no2", "SO2": "so2", "CO": "co", "O3": "o3"}
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "station_id"]
_K = ", ".join(_KEYS)


@query("station_day_index", f"""WITH {DAY_CTES}
SELECT d.station_id, obs_date, aqi, dominant, category, pm25_index, pm10_index, station_name, state
FROM day_index d LEFT JOIN {{v_stations}} s ON d.station_id = s.station_id""")
def station_day_index(t):
    days = flows.station_day_index(t.v_obs_long)
    return days.join(t.v_stations.select("station_id", "station_name", "state"), "station_id", "left").select(
        "station_id", "obs_date", "aqi", "dominant", "category", "pm25_index", "pm10_index", "station_name", "state")


_SYNONYM_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in V.POLLUTANT_SYNONYMS.items())
_NAMES = """CASE event_id % 9 WHEN 0 THEN 'pm 2.5' WHEN 1 THEN ' PM-10 ' WHEN 2 THEN 'ozone' WHEN 3 THEN 'Lead'
 WHEN 4 THEN 'n o 2' WHEN 5 THEN 'xylene' WHEN 6 THEN NULL WHEN 7 THEN 'PM2_5' ELSE event_type END"""


@query("std_pollutant_name", f"""WITH syn(k, v) AS (VALUES {_SYNONYM_ROWS}),
e AS (SELECT event_id, {_NAMES} AS raw FROM events)
SELECT event_id, coalesce(a.v, b.v) AS pollutant FROM e LEFT JOIN syn a ON a.k = raw
LEFT JOIN syn b ON b.k = lower(regexp_replace(trim(raw), '[ -]', '', 'g'))""")
def std_pollutant_name(t):
    raw = t.events.select("event_id", F.expr(_NAMES).alias("raw"))
    return raw.select("event_id", ax.standard_pollutant_name(F.col("raw")).alias("pollutant"))


@query("truncate_concentration", "SELECT " + _K + ", " + ", ".join(
    f"{cut_sql(p, c)} AS {c}_cut" for p, c in _WIDE.items()) + " FROM {v_obs_wide}")
def truncate_concentration(t):
    return t.v_obs_wide.select(*_KEYS, *[
        ax.truncate_concentration(p, F.col(c)).alias(f"{c}_cut") for p, c in _WIDE.items()])


@query("aqi_sub_index", "SELECT " + _K + ", " + ", ".join(
    f"{index_sql(p, c)} AS {c}_index" for p, c in _WIDE.items()) + ", "
    + sql_r(index_sql("PM2.5", "pm25", False)) + " AS pm25_raw FROM {v_obs_wide}")
def aqi_sub_index(t):
    out = ax.with_sub_indices(t.v_obs_wide, _WIDE)
    return out.select(*_KEYS, *[f"{c}_index" for c in _WIDE.values()],
                      r(ax.sub_index("PM2.5", F.col("pm25"), rounded=False)).alias("pm25_raw"))


@query("aqi_requirements", "SELECT " + _K + """,
 (CASE WHEN pm25 >= 0 THEN 1 ELSE 0 END + CASE WHEN o3 >= 0 THEN 1 ELSE 0 END + CASE WHEN co >= 1 THEN 1 ELSE 0 END) >= 3
 AND coalesce(pm25 >= 0, false) AS met FROM {v_obs_wide}""")
def aqi_requirements(t):
    met = ax.requirements_met({"PM2.5": F.col("pm25"), "O3": F.col("o3"), "CO": F.when(F.col("co") >= 1, F.col("co"))})
    return t.v_obs_wide.select(*_KEYS, met.alias("met"))


_IDX = {p: f"{c}_index" for p, c in _WIDE.items()}
_VALID = " + ".join(f"CASE WHEN {c} >= 0 THEN 1 ELSE 0 END" for c in _WIDE.values())


@query("aqi_overall", f"""WITH parts AS (SELECT *, {', '.join(f'{index_sql(p, c)} AS {c}_index' for p, c in _WIDE.items())} FROM {{v_obs_wide}}),
top AS (SELECT *, CASE WHEN ({_VALID}) >= 3 AND (coalesce(pm25 >= 0, false) OR coalesce(pm10 >= 0, false))
   THEN greatest({', '.join(_IDX.values())}) END AS aqi FROM parts)
SELECT {_K}, aqi, {dominant_sql(_IDX, 'aqi')} AS dominant,
 concat_ws(',', {', '.join(f"CASE WHEN {c} = aqi THEN '{p}' END" for p, c in sorted(_IDX.items()))}) AS tied FROM top""")
def aqi_overall(t):
    out = ax.with_index(t.v_obs_wide, _WIDE, enforce_requirements=True, tied=True)
    return out.select(*_KEYS, "aqi", "dominant", F.concat_ws(",", "tied").alias("tied"))


@query("aqi_category", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 {category_sql("CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity * 11 END")} AS category FROM lineitem""")
def aqi_category(t):
    value = F.expr("CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity * 11 END")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ax.category(value).alias("category"))


_FOUR = ["pm25", "pm10", "no2", "so2"]
_FOUR_P = {p: c for p, c in _WIDE.items() if c in _FOUR}


@query("reconstruct_target", f"""WITH m AS (SELECT ordinal, pm25, pm10, no2, so2, CAST(NULL AS DOUBLE) AS aqi FROM {{v_raw}}),
a AS (SELECT ordinal, CASE WHEN (SELECT count(aqi) FROM m) > 0 THEN aqi ELSE
  CAST(greatest({', '.join(index_sql(p, c) for p, c in _FOUR_P.items())}) AS DOUBLE) END AS aqi FROM m)
SELECT * FROM a""")
def reconstruct_target(t):
    raw = t.v_raw.select("ordinal", *_FOUR, F.lit(None).cast("double").alias("aqi"))
    return flows.reconstruct_target(raw).select("ordinal", "aqi")


@query("wind_speed_direction", f"""SELECT {_K}, {sql_r('sqrt(u_wind * u_wind + v_wind * v_wind)')} AS speed,
 {sql_r('fmod(degrees(atan2(u_wind, v_wind)) + 360, 360)')} AS direction FROM {{v_obs_wide}}""")
def wind_speed_direction(t):
    u, v = F.col("u_wind"), F.col("v_wind")
    return t.v_obs_wide.select(*_KEYS, r(weather.wind_speed(u, v)).alias("speed"),
                               r(weather.wind_direction(u, v)).alias("direction"))


@query("calendar_features", """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
 CAST(month(o_orderdate) AS INTEGER) AS "month",
 CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Pre-Monsoon'
      WHEN month(o_orderdate) IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END AS season,
 isodow(o_orderdate) >= 6 AS weekend_flag FROM orders""")
def calendar_features(t):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in tm.calendar_columns(F.col("o_orderdate")).items()])


@query("temporal_keys", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS "date",
 strftime(ts, '%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS "time",
 CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_ts FROM events""")
def temporal_keys(t):
    parsed = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return parsed.select("event_id", *[c.alias(n) for n, c in tm.time_keys(F.col("ts")).items()])


_RAW_TIME = """CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T10:20:30+05:30'
 WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 10:20:30' WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
 WHEN 3 THEN '   ' WHEN 4 THEN 'not a time' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T10:20:30Z' END"""


@query("normalize_datetime", """WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, o_orderdate FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN d || 'T10:20:30+05:30' WHEN 1 THEN d || 'T10:20:30' WHEN 2 THEN d || 'T00:00:00'
  WHEN 5 THEN d || 'T10:20:30+00:00' END AS iso,
 CASE k WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '290 minutes 30 seconds'
        WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '620 minutes 30 seconds' WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP)
        WHEN 5 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '620 minutes 30 seconds' END AS instant FROM d""")
def normalize_datetime(t):
    raw = t.orders.select("o_orderkey", F.expr(_RAW_TIME).alias("raw"))
    return raw.select("o_orderkey", tm.iso_text(F.col("raw")).alias("iso"), tm.instant(F.col("raw")).alias("instant"))


@query("parse_date_time", """SELECT ordinal, CASE WHEN "date" = 'someday' OR "time" = '25:00:00' THEN NULL
 ELSE try_strptime("date" || ' ' || "time", '%Y-%m-%d %H:%M:%S') END AS parsed FROM {v_merged}""")
def parse_date_time(t):
    return t.v_merged.select("ordinal", tm.parse_date_time(F.col("date"), F.col("time")).alias("parsed"))


@query("haversine_km", f"""SELECT ordinal, {sql_r(haversine_sql('latitude', 'longitude', '28.6139', '77.209'))} AS km_match,
 {sql_r(haversine_sql('latitude', 'longitude', '28.6139', '77.209', 6371.0))} AS km_tolerance FROM {{v_pixels}}""")
def haversine_km(t):
    here = (F.col("latitude"), F.col("longitude"), F.lit(28.6139), F.lit(77.209))
    return t.v_pixels.select("ordinal", r(geo.haversine_km(*here)).alias("km_match"),
                             r(geo.haversine_km(*here, radius=V.EARTH_RADIUS_TOLERANCE_KM)).alias("km_tolerance"))


_BOX = (68.0, 6.0, 98.0, 38.0)
_RES = 100.0
_LAT_STEP, _LON_STEP, _NLAT, _NLON = grids.grid_shape(_BOX, _RES)


@query("analysis_grid", f"""WITH cells AS (
 SELECT i * {_NLON} + j AS id, i, j, round({_BOX[1]} + CAST({_LAT_STEP!r} AS DOUBLE) * (i + 0.5), 5) AS latitude,
  round({_BOX[0]} + CAST({_LON_STEP!r} AS DOUBLE) * (j + 0.5), 5) AS longitude
 FROM range({_NLAT}) a(i), range({_NLON}) b(j)),
hits AS (SELECT CAST(floor((latitude - {_BOX[1]}) / CAST({_LAT_STEP!r} AS DOUBLE)) AS BIGINT) AS i,
 CAST(floor((longitude - {_BOX[0]}) / CAST({_LON_STEP!r} AS DOUBLE)) AS BIGINT) AS j, count(*) AS n, avg(aod) AS aod FROM {{v_pixels}} GROUP BY ALL)
SELECT printf('GRID_%06d', id) AS grid_id, printf('CELL_%06d', id) AS cell_id, latitude, longitude,
 {sql_r(f'longitude - CAST({_LON_STEP!r} AS DOUBLE) / 2')} AS west, {sql_r(f'latitude + CAST({_LAT_STEP!r} AS DOUBLE) / 2')} AS north,
 coalesce(n, 0) AS n_pixels, {sql_r('aod')} AS aod FROM cells LEFT JOIN hits USING (i, j)""")
def analysis_grid(t):
    grid = grids.analysis_grid(t.spark, _BOX, _RES)
    row, col = grids.cell_of(F.col("latitude"), F.col("longitude"), _BOX, _RES)
    hits = t.v_pixels.groupBy(row.alias("row"), col.alias("col")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("aod").alias("aod"))
    return grid.join(hits, ["row", "col"], "left").select(
        "grid_id", "cell_id", "latitude", "longitude",
        r(F.col("corners")[0][0]).alias("west"), r(F.col("corners")[2][1]).alias("north"),
        F.coalesce("n", F.lit(0)).alias("n_pixels"), r("aod").alias("aod"))


@query("severity_bands", """SELECT event_id,
 CASE WHEN value >= 200 THEN 'extreme' WHEN value >= 100 THEN 'high' WHEN value >= 30 THEN 'moderate' ELSE 'low' END AS map_band,
 CASE WHEN value < 20 THEN '0-20' WHEN value < 100 THEN '20-100' WHEN value < 300 THEN '100-300' ELSE '300+' END AS legend_band,
 CASE WHEN value / 10 < 5 THEN '0-5' WHEN value / 10 < 10 THEN '5-10' WHEN value / 10 < 15 THEN '10-15' ELSE '15+' END AS hcho_band,
 """ + sql_r("least(greatest(value / 15, 6), 22)") + " AS radius FROM events")
def severity_bands(t):
    frp = F.col("value")
    return t.events.select("event_id", bands.fire_map_band(frp).alias("map_band"), bands.fire_legend_band(frp).alias("legend_band"),
                           bands.hcho_legend_band(frp / 10).alias("hcho_band"), r(bands.marker_radius(frp)).alias("radius"))


@query("text_normalise", "SELECT ordinal, lower(trim(coalesce(city, ''))) AS city, lower(trim(coalesce(station_id, ''))) AS station_id FROM {v_registry}")
def text_normalise(t):
    return t.v_registry.select("ordinal", text.folded(F.col("city")).alias("city"), text.folded(F.col("station_id")).alias("station_id"))


@query("unit_round_coords", f"SELECT ordinal, {sql_r('round_even(latitude + 0.03, 1)')} AS latitude, {sql_r('round_even(longitude + 0.03, 1)')} AS longitude FROM {{v_pixels}}")
def unit_round_coords(t):
    return t.v_pixels.select("ordinal", r(geo.tenth_degree(F.col("latitude") + 0.03)).alias("latitude"),
                             r(geo.tenth_degree(F.col("longitude") + 0.03)).alias("longitude"))


# -- service queries ----------------------------------------------------------------------------


@query("aqi_daily_summary", f"""WITH {DAY_CTES},
j AS (SELECT s.state AS region, d.* FROM day_index d JOIN {{v_stations}} s ON d.station_id = s.station_id WHERE s.is_active AND aqi IS NOT NULL)
SELECT region, obs_date, {sql_r('round_even(avg(aqi), 1)')} AS avg_aqi, max(aqi) AS max_aqi, min(aqi) AS min_aqi, count(*) AS n_readings,
 count(DISTINCT station_id) AS station_count, max(struct_pack(a := aqi, d := dominant)).d AS dominant_pollutant
FROM j GROUP BY region, obs_date""")
def aqi_daily_summary(t):
    active = t.v_stations.where("is_active").select("station_id", F.col("state").alias("region"))
    readings = flows.station_day_index(t.v_obs_long).join(active, "station_id")
    return serve.daily_summary(readings).withColumn("avg_aqi", r("avg_aqi"))


@query("category_distribution", f"""WITH {DAY_CTES}
SELECT category, count(*) AS n, CAST(CASE category WHEN 'Good' THEN 1 WHEN 'Satisfactory' THEN 2 WHEN 'Moderate' THEN 3
 WHEN 'Poor' THEN 4 WHEN 'Very Poor' THEN 5 ELSE 6 END AS INTEGER) AS severity FROM day_index WHERE aqi IS NOT NULL GROUP BY category""")
def category_distribution(t):
    return serve.category_distribution(flows.station_day_index(t.v_obs_long))


@query("fire_hourly_timeline", f"""SELECT CAST(date_trunc('hour', detected_at) AS TIMESTAMP) AS hour_ts, count(frp) AS n_fires,
 {sql_r('sum(frp)', 3)} AS total_frp FROM {{v_fires}} GROUP BY 1""")
def fire_hourly_timeline(t):
    return serve.fire_hourly_timeline(t.v_fires).withColumn("total_frp", r("total_frp", 3))


@query("fire_kpis", f"""SELECT count(*) AS n_fires, {sql_r('sum(frp)', 3)} AS total_frp, count(*) FILTER (WHERE confidence = 'high') AS n_high,
 count(DISTINCT land_cover) AS n_covers FROM {{v_fires}}""")
def fire_kpis(t):
    return serve.fire_kpis(t.v_fires).withColumn("total_frp", r("total_frp", 3))


@query("hotspot_kpis", f"""SELECT count(*) AS n_hotspots, {sql_r('avg(column_density)')} AS mean_density,
 count(*) FILTER (WHERE source_type = 'industrial') AS n_industrial, count(*) FILTER (WHERE confidence >= 0.85) AS n_confident FROM {{v_hotspots}}""")
def hotspot_kpis(t):
    return serve.hotspot_kpis(t.v_hotspots).withColumn("mean_density", r("mean_density"))


@query("ordered_time_series", """WITH p AS (SELECT max(ts) AS now FROM {v_obs_wide})
SELECT l_orderkey, l_linenumber, l_partkey, ts, 'pm25' AS pollutant, pm25 AS value FROM {v_obs_wide}, p WHERE station_id = 1 AND ts > now - INTERVAL '365' DAY
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, ts, 'pm10', pm10 FROM {v_obs_wide}, p WHERE station_id = 1 AND ts > now - INTERVAL '365' DAY""")
def ordered_time_series(t):
    now = t.v_obs_wide.agg(F.max("ts").alias("now")).scalar()
    obs = t.v_obs_wide.select("l_orderkey", "l_linenumber", "l_partkey", "station_id", "ts", "pm25", "pm10")
    return serve.time_series(obs, 1, now, 365, ["pm25", "pm10"]).drop("station_id")


@query("monthly_trend", f"""WITH m AS (SELECT source_type, strftime(detected_at, '%Y-%m') AS "month", avg(column_density) AS mean_value FROM {{v_hotspots}} GROUP BY ALL),
b AS (SELECT source_type, strftime(detected_at, '%m') AS mm, avg(column_density) AS base FROM {{v_hotspots}} GROUP BY ALL)
SELECT m.source_type, "month", {sql_r('mean_value')} AS mean_value, {sql_r('mean_value - base')} AS anomaly
FROM m JOIN b ON m.source_type = b.source_type AND substr("month", 6, 2) = mm""")
def monthly_trend(t):
    out = serve.monthly_trend(t.v_hotspots, "detected_at", "column_density", "source_type")
    return out.withColumns({"mean_value": r("mean_value"), "anomaly": r("anomaly")})


@query("monthly_trend_orders", f"""WITH m AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS "month", avg(o_totalprice) AS mean_value FROM orders GROUP BY ALL),
b AS (SELECT o_orderstatus, strftime(o_orderdate, '%m') AS mm, avg(o_totalprice) AS base FROM orders GROUP BY ALL)
SELECT m.o_orderstatus, "month", {sql_r('mean_value')} AS mean_value, {sql_r('mean_value - base')} AS anomaly
FROM m JOIN b ON m.o_orderstatus = b.o_orderstatus AND substr("month", 6, 2) = mm""")
def monthly_trend_orders(t):
    out = serve.monthly_trend(t.orders, "o_orderdate", "o_totalprice", "o_orderstatus")
    return out.withColumns({"mean_value": r("mean_value"), "anomaly": r("anomaly")})


@query("forecast_expand", f"""WITH b AS (SELECT s.station_id, coalesce(sqrt(m.base) * 20, 150.0) AS base FROM {{v_stations}} s
 LEFT JOIN (SELECT user_id AS station_id, max_by(value, ts) AS base FROM events GROUP BY 1) m ON m.station_id = s.station_id),
st AS (SELECT station_id, base, h, TIMESTAMP '2024-02-01 00:00:00' + to_hours(h) AS forecast_at FROM b, range(1, 73) g(h)),
p AS (SELECT *, greatest(0, round_even(base * (1.0::DOUBLE + 0.15::DOUBLE * (1.0::DOUBLE - abs(hour(forecast_at) - 6) / 12.0::DOUBLE)) - h * 0.8::DOUBLE, 1)) AS pr FROM st)
SELECT station_id, CAST(h AS INTEGER) AS step, forecast_at, {sql_r('pr', 1)} AS predicted_aqi,
 {sql_r('greatest(0, round_even(pr - (10.0::DOUBLE + h * 0.4::DOUBLE), 1))', 1)} AS lower_bound,
 {sql_r('round_even(pr + (10.0::DOUBLE + h * 0.4::DOUBLE), 1)', 1)} AS upper_bound, {category_sql('pr')} AS category FROM p""")
def forecast_expand(t):
    latest = serve.latest_values(t.events.select(
        F.col("user_id").alias("station_id"), "ts", F.col("value").alias("aqi")))
    bases = t.v_stations.select("station_id").join(latest.withColumn("base", F.sqrt("base") * 20), "station_id", "left")
    out = serve.forecast(bases, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.withColumns({c: r(c, 1) for c in ("predicted_aqi", "lower_bound", "upper_bound")})
