"""Matching in time and space, gridded products, rejection and collocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroframe.catalog.registry import query, r, sql_r
from aeroframe.catalog.sqltext import haversine_sql
from aeroframe.operators import align, grids, quality, spatial
from aeroframe.plans import flows

_TS = '"timestamp"'

# nearest grid time per observation by brute force: earlier time on a tie
_NEAREST = f"""times AS (SELECT DISTINCT {_TS} AS g FROM {{v_pixels}}),
near AS (SELECT o.ordinal, arg_min(g, struct_pack(d := abs(epoch_us(g) - epoch_us(o.ts)), g := g)) AS snapshot_ts
  FROM {{v_obs_long}} o, times GROUP BY o.ordinal)"""


@query("asof_nearest_time", f"WITH {_NEAREST} SELECT ordinal, snapshot_ts FROM near")
def asof_nearest_time(t):
    return align.asof_nearest_time(t.v_obs_long, t.v_pixels, "ts", "timestamp").select("ordinal", "snapshot_ts")


@query("asof_grid_features", f"""WITH {_NEAREST},
ends AS (SELECT {_TS} AS g, arg_min(struct_pack(a := aod, h := hcho), ordinal) AS head, arg_max(struct_pack(a := aod, h := hcho), ordinal) AS tail FROM {{v_pixels}} GROUP BY 1)
SELECT o.ordinal, n.snapshot_ts, {sql_r('CASE WHEN o.ts >= n.snapshot_ts THEN e.tail.a ELSE e.head.a END')} AS aod,
 {sql_r('CASE WHEN o.ts >= n.snapshot_ts THEN e.tail.h ELSE e.head.h END')} AS hcho
FROM {{v_obs_long}} o LEFT JOIN near n ON n.ordinal = o.ordinal LEFT JOIN ends e ON e.g = n.snapshot_ts""")
def asof_grid_features(t):
    grid = t.v_pixels.select("ordinal", "timestamp", "aod", "hcho")
    out = align.asof_features(t.v_obs_long.select("ordinal", "ts"), grid, ["aod", "hcho"], "ts", "timestamp")
    return out.select("ordinal", "snapshot_ts", r("aod").alias("aod"), r("hcho").alias("hcho"))


@query("align_hourly", f"""WITH m AS (SELECT date_trunc('hour', {_TS}) AS h, avg(aod) AS aod, avg(hcho) AS hcho FROM {{v_pixels}} GROUP BY 1)
SELECT o.ordinal, {sql_r('aod')} AS aod, {sql_r('hcho')} AS hcho FROM {{v_obs_long}} o LEFT JOIN m ON m.h = date_trunc('hour', o.ts)""")
def align_hourly(t):
    grid = t.v_pixels.select("timestamp", "aod", "hcho")
    out = align.align_hourly(t.v_obs_long.select("ordinal", "ts"), grid, ["aod", "hcho"], "ts", "timestamp")
    return out.select("ordinal", r("aod").alias("aod"), r("hcho").alias("hcho"))


@query("align_daily_average", f"""WITH m AS (SELECT date_trunc('day', {_TS}) AS h, avg(aod) AS aod, avg(hcho) AS hcho FROM {{v_pixels}} GROUP BY 1)
SELECT o.ordinal, {sql_r('aod')} AS aod, {sql_r('hcho')} AS hcho FROM {{v_obs_long}} o LEFT JOIN m ON m.h = date_trunc('day', o.ts)""")
def align_daily_average(t):
    grid = t.v_pixels.select("timestamp", "aod", "hcho")
    out = align.align_daily(t.v_obs_long.select("ordinal", "ts"), grid, ["aod", "hcho"], "ts", "timestamp")
    return out.select("ordinal", r("aod").alias("aod"), r("hcho").alias("hcho"))


@query("cell_daily_average", f"""SELECT CAST(date_trunc('day', {_TS}) AS TIMESTAMP) AS {_TS}, latitude, longitude, {sql_r('avg(aod)')} AS aod, {sql_r('avg(temperature)')} AS temperature
FROM {{v_pixels}} GROUP BY 1, 2, 3""")
def cell_daily_average(t):
    out = align.cell_day_means(t.v_pixels, ["aod", "temperature"], "timestamp", "latitude", "longitude")
    return out.withColumns({c: r(c) for c in ("aod", "temperature")})


_DIST = haversine_sql("s.latitude", "s.longitude", "g.latitude", "g.longitude")


@query("nearest_grid_cell", f"""SELECT s.station_id, {sql_r(f'min({_DIST})')} AS satellite_match_distance_km,
 arg_min(struct_pack(x := g.aod), struct_pack(d := {_DIST}, o := g.ordinal)).x AS aod FROM {{v_stations}} s, {{v_pixels}} g GROUP BY s.station_id""")
def nearest_grid_cell(t):
    out = spatial.match_points(t.v_stations.select("station_id", "latitude", "longitude"), t.v_pixels, ["aod"], "satellite")
    return out.select("station_id", r("satellite_match_distance_km").alias("satellite_match_distance_km"), "aod")


# observations with a place, and the nearest pixel of the chosen snapshot by brute force
_PLACED = """placed AS (SELECT o.ordinal, o.ts, s.latitude, s.longitude, s.station_id FROM {v_obs_long} o LEFT JOIN {v_stations} s ON o.station_id = s.station_id)"""


def _attach_sql(snapshots: str, cells: str, tie: str) -> str:
    return f"""WITH {_PLACED}, {snapshots},
cells AS ({cells}),
pairs AS (SELECT DISTINCT snapshot_ts, latitude, longitude FROM placed JOIN snap USING (ordinal) WHERE latitude IS NOT NULL),
best AS (SELECT s.snapshot_ts, s.latitude, s.longitude, min({_DIST}) AS d,
  arg_min(struct_pack(a := g.aod, h := g.hcho), struct_pack(d := {_DIST}, {tie})) AS f
  FROM pairs s JOIN cells g ON g.snapshot_ts = s.snapshot_ts GROUP BY 1, 2, 3)
SELECT p.ordinal, {sql_r('f.a')} AS aod, {sql_r('f.h')} AS hcho, {sql_r('d')} AS satellite_match_distance_km
FROM placed p LEFT JOIN snap USING (ordinal) LEFT JOIN best b ON b.snapshot_ts = snap.snapshot_ts AND b.latitude = p.latitude AND b.longitude = p.longitude"""


def _attached(t, strategy):
    places = t.v_stations.select("station_id", "latitude", "longitude")
    obs = t.v_obs_long.select("ordinal", "station_id", "ts").join(places, "station_id", "left").drop("station_id")
    grid = t.v_pixels.select("ordinal", "timestamp", "latitude", "longitude", "aod", "hcho")
    out = flows.attach_grid(obs, grid, ["aod", "hcho"], "satellite", strategy)
    return out.select("ordinal", *[r(c).alias(c) for c in ("aod", "hcho", "satellite_match_distance_km")])


@query("attach_grid_features", _attach_sql(_NEAREST + ", snap AS (SELECT * FROM near)",
                                           f"SELECT {_TS} AS snapshot_ts, latitude, longitude, aod, hcho, ordinal FROM {{v_pixels}}", "o := g.ordinal"))
def attach_grid_features(t):
    return _attached(t, "nearest")


@query("attach_grid_hourly", _attach_sql("snap AS (SELECT ordinal, date_trunc('hour', ts) AS snapshot_ts FROM {v_obs_long})",
                                         f"SELECT date_trunc('hour', {_TS}) AS snapshot_ts, latitude, longitude, aod, hcho, ordinal FROM {{v_pixels}}", "o := g.ordinal"))
def attach_grid_hourly(t):
    return _attached(t, "hourly")


@query("attach_grid_daily", _attach_sql("snap AS (SELECT ordinal, date_trunc('day', ts) AS snapshot_ts FROM {v_obs_long})",
                                        f"SELECT date_trunc('day', {_TS}) AS snapshot_ts, latitude, longitude, avg(aod) AS aod, avg(hcho) AS hcho FROM {{v_pixels}} GROUP BY 1, 2, 3",
                                        "o := g.latitude, p := g.longitude"))
def attach_grid_daily(t):
    return _attached(t, "daily_average")


@query("match_reference_times", """WITH refs AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '9' HOUR AS ref FROM events WHERE event_type = 'view')
SELECT ordinal, ts FROM {v_obs_long} o WHERE EXISTS (SELECT 1 FROM refs WHERE abs(epoch_us(ref) - epoch_us(o.ts)) <= 3600000000)""")
def match_reference_times(t):
    refs = t.events.where("event_type = 'view'").select(
        (F.date_trunc("day", "ts") + F.expr("interval 9 hours")).alias("ref_ts"))
    return align.match_reference_times(t.v_obs_long, refs).select("ordinal", "ts")


# -- gridded products ------------------------------------------------------------------------------


@query("band_mean_grid", f"""SELECT TIMESTAMP '2024-01-05 00:00:00' AS {_TS}, {sql_r('round_even(latitude, 1)', 1)} AS latitude, {sql_r('round_even(longitude, 1)', 1)} AS longitude, {sql_r('avg(aod)')} AS aod
FROM {{v_pixels}} WHERE {_TS} >= TIMESTAMP '2024-01-05' AND {_TS} < TIMESTAMP '2024-01-20' GROUP BY 2, 3""")
def band_mean_grid(t):
    day = lambda d: F.lit(d).cast("timestamp")
    out = grids.band_mean_grid(t.v_pixels, "aod", day("2024-01-05"), day("2024-01-20"), "timestamp", "latitude", "longitude")
    return out.withColumns({"latitude": r("latitude", 1), "longitude": r("longitude", 1), "aod": r("aod")})


def _product_sql(band: str) -> str:
    return f"""SELECT date_trunc('day', {_TS}) AS {_TS}, round_even(latitude, 1) AS latitude, round_even(longitude, 1) AS longitude, avg({band}) AS {band}
 FROM {{v_pixels}} WHERE qa_value >= {0.2 if band == 'aod' else 0.5} GROUP BY 1, 2, 3"""


@query("merge_products", f"""WITH a AS ({_product_sql('aod')}), b AS ({_product_sql('hcho')}), c AS ({_product_sql('no2_column')})
SELECT CAST({_TS} AS TIMESTAMP) AS {_TS}, {sql_r('latitude', 1)} AS latitude, {sql_r('longitude', 1)} AS longitude, {sql_r('aod')} AS aod, {sql_r('hcho', 9)} AS hcho, {sql_r('no2_column', 9)} AS no2_column, CAST(NULL AS DOUBLE) AS so2_column
FROM a FULL OUTER JOIN b USING ({_TS}, latitude, longitude) FULL OUTER JOIN c USING ({_TS}, latitude, longitude)""")
def merge_products(t):
    def product(band, qa):
        # several pixels of a day round to one key
        return t.v_pixels.where(F.col("qa_value") >= qa).select(F.date_trunc("day", "timestamp").alias("timestamp"), "latitude", "longitude", band)
    out = grids.merge_products([product("aod", 0.2), product("hcho", 0.5), product("no2_column", 0.5)],
                               ["aod", "hcho", "no2_column", "so2_column"])
    return out.withColumns({"latitude": r("latitude", 1), "longitude": r("longitude", 1), "aod": r("aod"),
                            "hcho": r("hcho", 9), "no2_column": r("no2_column", 9)})


@query("era5_daily_mean", f"""SELECT latitude, longitude, CAST(date_trunc('day', {_TS}) AS TIMESTAMP) AS day_ts, {sql_r('avg(temperature)')} AS temperature, {sql_r('sum(relative_humidity)')} AS relative_humidity
FROM {{v_pixels}} GROUP BY 1, 2, 3""")
def era5_daily_mean(t):
    out = grids.daily_cell_means(t.v_pixels, ["temperature", "relative_humidity"], ["latitude", "longitude"], "timestamp", ["relative_humidity"])
    return out.withColumns({"temperature": r("temperature"), "relative_humidity": r("relative_humidity")})


@query("placeholder_grid", f"""SELECT DISTINCT date_trunc('hour', o.ts) AS {_TS}, latitude, longitude, CAST(NULL AS DOUBLE) AS aod, CAST(NULL AS DOUBLE) AS hcho
FROM {{v_obs_long}} o JOIN {{v_stations}} s ON o.station_id = s.station_id""")
def placeholder_grid(t):
    placed = t.v_obs_long.select("station_id", F.date_trunc("hour", "ts").alias("ts")).join(
        t.v_stations.select("station_id", "latitude", "longitude"), "station_id")
    return grids.placeholder_rows(placed, ["aod", "hcho"])


@query("validate_grid_table", f"""WITH s AS (SELECT count(*) AS n, count(*) - count(DISTINCT ({_TS}, latitude, longitude)) AS dup,
 count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS nul FROM {{v_pixels}})
SELECT 'empty' AS "check", CASE WHEN n = 0 THEN 'FAILED' ELSE 'PASSED' END AS status, CAST(n = 0 AS BIGINT) AS n_found FROM s
UNION ALL SELECT 'duplicates', CASE WHEN dup > 0 THEN 'WARNING' ELSE 'PASSED' END, dup FROM s
UNION ALL SELECT 'null_coordinates', CASE WHEN nul > 0 THEN 'FAILED' ELSE 'PASSED' END, nul FROM s
UNION ALL SELECT 'empty_variables', 'FAILED', CAST(1 AS BIGINT) FROM s""")
def validate_grid_table(t):
    grid = t.v_pixels.withColumn("surface_pressure", F.lit(None).cast("double"))
    return quality.validate_grid(grid, ["temperature", "relative_humidity", "surface_pressure"])


# -- rejection and collocation -----------------------------------------------------------------------

_LAT, _LON = "TRY_CAST(latitude AS DOUBLE)", "TRY_CAST(longitude AS DOUBLE)"
_JUDGED = f"""early AS (SELECT *, CASE WHEN "date" = 'someday' OR "time" = '25:00:00' THEN 'bad_timestamp'
  WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinate' WHEN {_LAT} IS NULL OR {_LON} IS NULL THEN 'non_numeric_coordinate'
  WHEN NOT ({_LAT} BETWEEN -90 AND 90 AND {_LON} BETWEEN -180 AND 180) THEN 'outside_world'
  WHEN NOT ({_LAT} BETWEEN 6 AND 38 AND {_LON} BETWEEN 68 AND 98) THEN 'outside_region' END AS e FROM {{v_merged}}),
firsts AS (SELECT ordinal, row_number() OVER (PARTITION BY station_id, "date", "time" ORDER BY ordinal) AS rn FROM early WHERE e IS NULL),
judged AS (SELECT early.*, CASE WHEN e IS NOT NULL THEN e WHEN rn > 1 THEN 'duplicate_station_time'
  WHEN satellite_match_distance_km > 50 THEN 'satellite_distance' WHEN era5_match_distance_km > 50 THEN 'era5_distance' END AS reason_code
  FROM early LEFT JOIN firsts USING (ordinal))"""


@query("reject_invalid_matches", f"""WITH {_JUDGED} SELECT ordinal, reason_code, CASE reason_code
 WHEN 'bad_timestamp' THEN 'Unparseable timestamp: Date=''' || "date" || ''', Time=''' || "time" || ''''
 WHEN 'missing_coordinate' THEN 'Missing coordinate: Latitude=''' || coalesce(latitude, 'nan') || ''', Longitude=''' || coalesce(longitude, 'nan') || ''''
 WHEN 'non_numeric_coordinate' THEN 'Non-numeric coordinate: Latitude=''' || latitude || ''', Longitude=''' || longitude || ''''
 WHEN 'outside_world' THEN 'Coordinate outside physical bounds: (' || latitude || ', ' || longitude || ')'
 WHEN 'outside_region' THEN 'Coordinate outside India bounding box [6–38°N, 68–98°E]: (' || latitude || ', ' || longitude || ')'
 WHEN 'duplicate_station_time' THEN 'Duplicate station-time observation for station=' || station_id || ', date=' || "date" || ', time=' || "time"
 WHEN 'satellite_distance' THEN 'Satellite match distance ' || printf('%.2f', satellite_match_distance_km) || 'km exceeds tolerance 50.0km'
 WHEN 'era5_distance' THEN 'ERA5 match distance ' || printf('%.2f', era5_match_distance_km) || 'km exceeds tolerance 50.0km' END AS reason FROM judged""")
def reject_invalid_matches(t):
    return quality.reject_invalid(t.v_merged).select("ordinal", "reason_code", "reason")


@query("temporal_tolerance", """WITH m AS (SELECT ts AS mid FROM {v_obs_long} ORDER BY ts LIMIT 1 OFFSET (SELECT count(ts) // 2 FROM {v_obs_long}))
SELECT ordinal, ts BETWEEN mid - INTERVAL '36' HOUR AND mid + INTERVAL '36' HOUR AS accepted FROM {v_obs_long}, m""")
def temporal_tolerance(t):
    return quality.within_time(t.v_obs_long, "ts", 36.0).select("ordinal", "accepted")


@query("spatial_tolerance", f"""WITH c AS (SELECT avg({_LAT}) AS y, avg({_LON}) AS x FROM {{v_merged}} WHERE {_LAT} IS NOT NULL AND {_LON} IS NOT NULL)
SELECT ordinal, coalesce({haversine_sql(_LAT, _LON, 'y', 'x', 6371.0)} <= 900, false) AS accepted FROM {{v_merged}}, c""")
def spatial_tolerance(t):
    return quality.within_radius(t.v_merged, tolerance_km=900.0).select("ordinal", "accepted")


@query("earliest_per_station_day", """WITH p AS (SELECT *, CASE WHEN "date" = 'someday' OR "time" = '25:00:00' THEN NULL ELSE CAST("date" || ' ' || "time" AS TIMESTAMP) END AS m FROM {v_merged})
SELECT ordinal, station_id, "date", "time" FROM p QUALIFY row_number() OVER (PARTITION BY station_id, "date" ORDER BY m NULLS LAST, ordinal) = 1""")
def earliest_per_station_day(t):
    return quality.earliest_per_station_day(t.v_merged).select("ordinal", "station_id", "date", "time")


_COLLOC = f"""WITH {_JUDGED},
staged AS (SELECT *, CASE WHEN reason_code IS NULL AND {haversine_sql(_LAT, _LON, '22.0', '83.0', 6371.0)} > 50 THEN 'outside_radius' ELSE reason_code END AS s FROM judged),
ranked AS (SELECT ordinal, row_number() OVER (PARTITION BY station_id, "date" ORDER BY CAST("date" || ' ' || "time" AS TIMESTAMP), ordinal) AS rn FROM staged WHERE s IS NULL),
final AS (SELECT staged.*, CASE WHEN s IS NULL AND rn > 1 THEN 'not_nearest_of_day' ELSE s END AS c FROM staged LEFT JOIN ranked USING (ordinal))"""


@query("collocate", f"""WITH {_JUDGED},
ranked AS (SELECT ordinal, row_number() OVER (PARTITION BY station_id, "date" ORDER BY CAST("date" || ' ' || "time" AS TIMESTAMP), ordinal) AS rn FROM judged WHERE reason_code IS NULL)
SELECT ordinal, station_id, CASE WHEN reason_code IS NULL AND rn > 1 THEN 'not_nearest_of_day' ELSE reason_code END AS reason_code FROM judged LEFT JOIN ranked USING (ordinal)""")
def collocate(t):
    return quality.collocate(t.v_merged).select("ordinal", "station_id", "reason_code")


@query("collocation_summary", f"""{_COLLOC}
SELECT count(*) AS input_rows, count(DISTINCT station_id) AS input_stations, count(*) FILTER (WHERE coalesce(c, 'kept') IN ('kept', 'not_nearest_of_day', 'outside_radius')) AS after_rejection,
 count(*) FILTER (WHERE coalesce(c, 'kept') IN ('kept', 'not_nearest_of_day', 'outside_radius')) AS after_time,
 count(*) FILTER (WHERE coalesce(c, 'kept') IN ('kept', 'not_nearest_of_day')) AS after_radius, count(*) FILTER (WHERE c IS NULL) AS collocated_rows,
 count(DISTINCT station_id) FILTER (WHERE c IS NULL) AS collocated_stations, CASE WHEN count(*) FILTER (WHERE c IS NULL) > 0 THEN 'SUCCESS' ELSE 'EMPTY' END AS status FROM final""")
def collocation_summary(t):
    return quality.collocation_summary(quality.collocate(t.v_merged, reference_point=(22.0, 83.0)))


@query("analysis_flow", f"""WITH {_JUDGED},
ranked AS (SELECT ordinal, row_number() OVER (PARTITION BY station_id, "date" ORDER BY CAST("date" || ' ' || "time" AS TIMESTAMP), ordinal) AS rn FROM judged WHERE reason_code IS NULL)
SELECT ordinal, station_id, pm25, aqi FROM judged JOIN ranked USING (ordinal) WHERE rn = 1 AND aqi IS NOT NULL""")
def analysis_flow(t):
    return flows.analysis_table(t.v_merged).where("aqi is not null").select("ordinal", "station_id", "pm25", "aqi")


# -- integration ---------------------------------------------------------------------------------------


@query("integrate_flow", f"""WITH {_NEAREST}, w AS (SELECT ordinal, station_id, ts, CASE WHEN pollutant = 'PM2.5' THEN value END AS pm25 FROM {{v_obs_long}}),
placed AS (SELECT w.*, 'Supplier#' || lpad(CAST(w.station_id AS VARCHAR), 9, '0') AS station_name, s.latitude, s.longitude, s.state, s.city, CAST(s.station_id AS VARCHAR) AS sid, n.snapshot_ts
  FROM w LEFT JOIN {{v_stations}} s ON s.station_name = 'Supplier#' || lpad(CAST(w.station_id AS VARCHAR), 9, '0') JOIN near n ON n.ordinal = w.ordinal),
pairs AS (SELECT DISTINCT snapshot_ts, latitude, longitude FROM placed WHERE latitude IS NOT NULL),
best AS (SELECT s.snapshot_ts, s.latitude, s.longitude, min({_DIST}) AS d, arg_min(struct_pack(a := g.aod, t := g.temperature, u := g.u_wind, v := g.v_wind), struct_pack(d := {_DIST}, o := g.ordinal)) AS f
  FROM pairs s JOIN {{v_pixels}} g ON g.{_TS} = s.snapshot_ts GROUP BY 1, 2, 3)
SELECT p.ordinal, sid AS station_id, station_name, state, pm25, {sql_r('f.a')} AS aod, {sql_r('f.t')} AS temperature, {sql_r('sqrt(f.u * f.u + f.v * f.v)')} AS wind_speed,
 {sql_r('d')} AS satellite_match_distance_km, {sql_r('d')} AS era5_match_distance_km, CAST(isodow(p.ts) - 1 AS INTEGER) AS day_of_week, 'Winter' AS season, false AS placeholder_used
FROM placed p LEFT JOIN best b ON b.snapshot_ts = p.snapshot_ts AND b.latitude = p.latitude AND b.longitude = p.longitude""")
def integrate_flow(t):
    obs = t.v_obs_long.select("ordinal", "ts", F.concat(F.lit("Supplier#"), F.lpad(F.col("station_id").cast("string"), 9, "0")).alias("station_name"),
                              F.when(F.col("pollutant") == "PM2.5", F.col("value")).alias("pm25"))
    registry = t.v_stations.select(F.col("station_id").cast("string").alias("station_id"), "station_name", "city", "state", "latitude", "longitude")
    satellite = t.v_pixels.select("ordinal", "timestamp", "latitude", "longitude", "aod", "hcho", "no2_column")
    weather = t.v_pixels.select("ordinal", "timestamp", "latitude", "longitude", "temperature", "relative_humidity", "u_wind", "v_wind")
    out = flows.integrate(obs, registry, satellite, weather)
    return out.select("ordinal", "station_id", "station_name", "state", "pm25", *[r(c).alias(c) for c in (
        "aod", "temperature", "wind_speed", "satellite_match_distance_km", "era5_match_distance_km")], "day_of_week", "season", "placeholder_used")
