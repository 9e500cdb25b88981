"""Columns, filters, cleaning, de-duplication and registry checks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from aeroframe import values as V
from aeroframe.catalog.registry import query, r, sql_r
from aeroframe.functions import masks
from aeroframe.operators import clean, columns as cols, dedup, filters, stations as reg
from aeroframe.plans import flows

_P = ["pm25", "pm10", "no2", "so2"]

# -- columns -------------------------------------------------------------------------------------


@query("rename_pollutant_columns", 'SELECT ordinal, station, pm25, pm10, no2 AS o3, so2 FROM {v_raw}')
def rename_pollutant_columns(t):
    raw = t.v_raw.select("ordinal", "station", F.col("pm25").alias("pm2_5"), F.col("pm10").alias("PM10"),
                         F.col("no2").alias("OZONE"), "so2")
    return cols.rename_pollutant_columns(raw)


@query("rename_grid_columns", 'SELECT ordinal, "timestamp", latitude, longitude, temperature, u_wind FROM {v_pixels}')
def rename_grid_columns(t):
    raw = t.v_pixels.select("ordinal", F.col("timestamp").alias("Date_Time"), F.col("latitude").alias(" LAT "),
                            F.col("longitude").alias("lng"), F.col("temperature").alias("2m temperature"), F.col("u_wind").alias("u10"))
    return cols.rename_grid_columns(raw, V.WEATHER_COLUMN_ALIASES)


@query("rename_station_columns", "SELECT station_id, station_name, city, state, latitude, longitude FROM {v_stations}")
def rename_station_columns(t):
    raw = t.v_stations.select(F.col("station_id").alias("ID"), F.col("station_name").alias("Station Name"), F.col("city").alias("City"),
                              F.col("state").alias(" state "), F.col("latitude").alias("Lat"), F.col("longitude").alias("LNG"))
    return cols.rename_station_columns(raw)


@query("ensure_columns", """SELECT ordinal, station_id, pm25, pm10, CAST(NULL AS DOUBLE) AS aod, CAST(NULL AS VARCHAR) AS season,
 satellite_match_distance_km FROM {v_merged}""")
def ensure_columns(t):
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("station_id", T.StringType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("pm25", "pm10", "aod")],
                           T.StructField("season", T.StringType()), T.StructField("satellite_match_distance_km", T.DoubleType())])
    return cols.ensure_columns(t.v_merged, schema)


@query("attach_units", "SELECT ordinal, pm25, 'ug/m3' AS pm25_unit, co, 'mg/m3' AS co_unit, aqi, 'index' AS aqi_unit FROM {v_merged}")
def attach_units(t):
    return cols.attach_units(t.v_merged.select("ordinal", "pm25", "co", "aqi"))


@query("select_by_group", "SELECT relative_humidity, surface_pressure, temperature, station_id, pm25, pm10, no2, so2, aqi FROM {v_features}")
def select_by_group(t):
    return cols.select_by_group(t.v_features, ["meteorology"])


@query("feature_target_split", "SELECT station_id, pm25, pm10, no2, so2, temperature, surface_pressure, aod, relative_humidity, aqi AS target FROM {v_features}")
def feature_target_split(t):
    names, target = cols.split_features(t.v_features, cols.target_column(t.v_features), numeric_only=True)
    return t.v_features.select(*names, F.col(target).alias("target"))


@query("align_columns", "SELECT pm25, pm10, CAST(0 AS DOUBLE) AS hcho, temperature FROM {v_features}")
def align_columns(t):
    return cols.align_columns(t.v_features, ["pm25", "pm10", "hcho", "temperature"])


# -- filters -------------------------------------------------------------------------------------


@query("drop_negative_rows", "SELECT ordinal, pm25, pm10, no2, so2 FROM {v_raw} WHERE NOT (coalesce(pm25 < 0, false) OR coalesce(pm10 < 0, false) OR no2 < 0 OR so2 < 0)")
def drop_negative_rows(t):
    return filters.drop_negative_rows(t.v_raw).select("ordinal", *_P)


@query("count_invalid_coords", """SELECT count(*) FILTER (WHERE TRY_CAST(latitude AS DOUBLE) NOT BETWEEN -90 AND 90
 OR TRY_CAST(longitude AS DOUBLE) NOT BETWEEN -180 AND 180) AS n_invalid, count(*) AS n_rows FROM {v_merged}""")
def count_invalid_coords(t):
    off = filters.invalid_coordinates(F.col("latitude"), F.col("longitude"))
    return t.v_merged.agg(F.count_if(off).alias("n_invalid"), F.count(F.lit(1)).alias("n_rows"))


@query("station_allow_list", """SELECT ordinal, station_id, value FROM {v_obs_long} WHERE station_id IN
 (SELECT station_id FROM {v_stations} WHERE is_active)""")
def station_allow_list(t):
    return filters.only_stations(t.v_obs_long, t.v_stations.where("is_active")).select("ordinal", "station_id", "value")


@query("station_allow_list_absent", """SELECT station_id FROM {v_stations} WHERE station_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def station_allow_list_absent(t):
    seen = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("station_id"))
    return filters.absent_stations(seen, t.v_stations)


@query("drop_null_target", "SELECT ordinal, aqi FROM {v_merged} WHERE aqi IS NOT NULL")
def drop_null_target(t):
    return t.v_merged.dropna(subset=["aqi"]).select("ordinal", "aqi")


@query("date_bbox_filter", """SELECT "timestamp", latitude, longitude, aod, hcho FROM {v_pixels}
 WHERE "timestamp" >= TIMESTAMP '2024-01-09' AND "timestamp" < TIMESTAMP '2024-01-13'
 AND latitude BETWEEN 6.7 AND 35.5 AND longitude BETWEEN 68.1 AND 97.4""")
def date_bbox_filter(t):
    start, end = filters.day_window(F.lit("2024-01-10").cast("date"), 1)
    end = F.date_add(end.cast("date"), 1).cast("timestamp")
    return filters.in_window(t.v_pixels, "timestamp", start, end, ["aod", "hcho"], V.INDIA_LOADER_BOX, "latitude", "longitude")


@query("qa_threshold_mask", "SELECT ordinal, qa_value, hcho FROM {v_pixels} WHERE qa_value >= 0.5")
def qa_threshold_mask(t):
    return t.v_pixels.where(masks.qa_value_ok(F.col("qa_value"))).select("ordinal", "qa_value", "hcho")


@query("qa_bitmask_mask", "SELECT ordinal, qa_bits, aod FROM {v_pixels} WHERE (qa_bits & 7) = 1 AND (qa_bits & 3840) = 0")
def qa_bitmask_mask(t):
    return t.v_pixels.where(masks.aerosol_qa_ok(F.col("qa_bits"))).select("ordinal", "qa_bits", "aod")


@query("fire_confidence_mask", "SELECT event_id, confidence_code, confidence_code IN (2, 104) AS high, confidence_code NOT IN (0, 108) AS nominal, true AS low FROM {v_fires}")
def fire_confidence_mask(t):
    code = F.col("confidence_code")
    return t.v_fires.select("event_id", "confidence_code", *[masks.fire_confidence_ok(code, lv).alias(lv) for lv in ("high", "nominal", "low")])


@query("cloud_bit_masks", f"""SELECT ordinal, qa_bits, (qa_bits >> 10) & 1 = 0 AND (qa_bits >> 11) & 1 = 0 AS optical,
 (qa_bits >> 3) & 1 = 0 AND (qa_bits >> 4) & 1 = 0 AND (qa_bits >> 5) & 1 = 0 AS surface, {sql_r('temperature / 10000')} AS reflectance FROM {{v_pixels}}""")
def cloud_bit_masks(t):
    qa = F.col("qa_bits")
    return t.v_pixels.select("ordinal", "qa_bits", masks.optical_clear(qa).alias("optical"), masks.surface_clear(qa).alias("surface"),
                             r(masks.optical_reflectance(F.col("temperature"))).alias("reflectance"))


@query("fire_query", """SELECT event_id, detected_at, frp, confidence FROM {v_fires} WHERE frp >= 10
 AND detected_at > (SELECT max(detected_at) FROM {v_fires}) - INTERVAL '240' HOUR""")
def fire_query(t):
    latest = t.v_fires.agg(F.max("detected_at").alias("m")).scalar()
    return filters.fires(t.v_fires, 10.0, latest, 240).select("event_id", "detected_at", "frp", "confidence")


@query("hotspot_query", "SELECT hotspot_id, detected_at, column_density, confidence FROM {v_hotspots} WHERE confidence >= 0.6")
def hotspot_query(t):
    return filters.hotspots(t.v_hotspots).select("hotspot_id", "detected_at", "column_density", "confidence")


@query("station_query", """SELECT station_id, station_name, state, network FROM {v_stations} WHERE is_active AND lower(state) LIKE '%nation%'
 AND lower(network) = 'cpcb'""")
def station_query(t):
    return filters.stations(t.v_stations, state="Nation", network="cpcb").select("station_id", "station_name", "state", "network")


# -- cleaning ------------------------------------------------------------------------------------


@query("pivot_first", """SELECT station_id, CAST(ts AS DATE) AS obs_date,
 min_by(value, ordinal) FILTER (WHERE pollutant = 'PM2.5' AND value IS NOT NULL) AS pm25,
 min_by(value, ordinal) FILTER (WHERE pollutant = 'PM10' AND value IS NOT NULL) AS pm10,
 min_by(value, ordinal) FILTER (WHERE pollutant = 'NO2' AND value IS NOT NULL) AS no2,
 min_by(value, ordinal) FILTER (WHERE pollutant = 'SO2' AND value IS NOT NULL) AS so2,
 CAST(NULL AS DOUBLE) AS co,
 min_by(value, ordinal) FILTER (WHERE pollutant IN ('O3', 'OZONE') AND value IS NOT NULL) AS o3
 FROM {v_obs_long} GROUP BY station_id, CAST(ts AS DATE)""")
def pivot_first(t):
    dated = t.v_obs_long.withColumn("obs_date", F.to_date("ts"))
    names = {p: V.POLLUTANT_COLUMNS[p] for p in ("PM2.5", "PM10", "NO2", "SO2", "CO", "O3")}
    return clean.pivot_first(dated, ["station_id", "obs_date"], names)


# exact counterparts of the cleaning steps, shared below
_ONCE = """once AS (SELECT min(ordinal) AS ordinal, count(*) AS copies, station, ts, pm25, pm10, no2, so2, latitude, longitude
  FROM {v_raw} GROUP BY station, ts, pm25, pm10, no2, so2, latitude, longitude),
marked AS (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY ordinal) = 1 AS is_first,
  coalesce(pm25 < 0, false) OR coalesce(pm10 < 0, false) OR coalesce(no2 < 0, false) OR coalesce(so2 < 0, false) AS is_negative FROM once),
kept AS (SELECT * FROM marked WHERE is_first AND NOT is_negative),
q AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in _P) + " FROM kept)"


def _outlier_sql(c: str) -> str:
    return (f"coalesce({c}_3 - {c}_1 <> 0 AND ({c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1)), false)")


@query("dedup_rows", "SELECT min(ordinal) AS ordinal, count(*) AS copies, station, ts, pm25, pm10, no2, so2, latitude, longitude FROM {v_raw} GROUP BY ALL")
def dedup_rows(t):
    return dedup.distinct_rows(t.v_raw, "ordinal", copies="copies")


@query("dedup_station_time", "SELECT * FROM {v_raw} QUALIFY row_number() OVER (PARTITION BY station, ts ORDER BY ordinal) = 1")
def dedup_station_time(t):
    return dedup.first_per_key(t.v_raw, ["station", "ts"], ["ordinal"])


@query("iqr_outlier_flags", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in _P) + " FROM {v_raw}) SELECT ordinal, "
    + ", ".join(f"{_outlier_sql(c)} AS {c}_outlier" for c in _P) + " FROM {v_raw}, q")
def iqr_outlier_flags(t):
    return clean.flag_outliers(t.v_raw, _P).select("ordinal", *[f"{c}_outlier" for c in _P])


_METRICS = f"""WITH {_ONCE}
SELECT CAST(sum(copies) AS BIGINT) AS rows_before, count(*) FILTER (WHERE is_first AND NOT is_negative) AS rows_after,
 CAST(sum(copies * ({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in ['station', 'ts', *_P, 'latitude', 'longitude'])})) AS BIGINT) AS missing_values,
 CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed, count(*) FILTER (WHERE NOT is_first) AS duplicate_timestamps_removed,
 count(*) FILTER (WHERE is_first AND is_negative) AS negative_pollutant_values,
 (SELECT CAST(sum({' + '.join(f'CASE WHEN {_outlier_sql(c)} THEN 1 ELSE 0 END' for c in _P)}) AS BIGINT) FROM kept, q) AS outlier_count,
 count(*) FILTER (WHERE is_first AND NOT is_negative AND (latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180)) AS invalid_coordinates
FROM marked"""


@query("cleaning_metrics", _METRICS)
def cleaning_metrics(t):
    return clean.cleaning_metrics(t.v_raw, "station", "ts", _P, "ordinal", "latitude", "longitude")


@query("sink_quality_report", f"""SELECT 'ORDERS' AS dataset, 'orders.parquet' AS source_file, m.*, CAST(0 AS BIGINT) AS station_metadata_mismatches,
 TIMESTAMP '2024-02-01 00:00:00' AS cleaning_timestamp, 'first; second' AS warnings, '' AS errors FROM ({_METRICS}) m""")
def sink_quality_report(t):
    metrics = clean.cleaning_metrics(t.v_raw, "station", "ts", _P, "ordinal", "latitude", "longitude")
    return clean.quality_report(metrics, "ORDERS", "orders.parquet", stamp=F.lit("2024-02-01 00:00:00").cast("timestamp"),
                                warnings=["first", "second"])


@query("clean_flow", f"""WITH {_ONCE} SELECT ordinal, station, ts, pm25, pm10, no2, so2, latitude, longitude,
 {', '.join(f'{_outlier_sql(c)} AS {c}_outlier' for c in _P)}, {', '.join(f"'ug/m3' AS {c}_unit" for c in _P)} FROM kept, q""")
def clean_flow(t):
    return flows.clean_table(t.v_raw, "station", "ts")


# -- stations ------------------------------------------------------------------------------------


@query("join_station_metadata", """SELECT o.l_orderkey, o.l_linenumber, o.l_partkey, o.station_id, o.station_name, s.station_id AS station_id_metadata, s.state, s.latitude
 FROM (SELECT *, 'Supplier#' || lpad(CAST(station_id AS VARCHAR), 9, '0') AS station_name FROM {v_obs_wide}) o
 LEFT JOIN {v_stations} s ON o.station_name IS NOT DISTINCT FROM s.station_name""")
def join_station_metadata(t):
    obs = t.v_obs_wide.select("l_orderkey", "l_linenumber", "l_partkey", "station_id",
                              F.concat(F.lit("Supplier#"), F.lpad(F.col("station_id").cast("string"), 9, "0")).alias("station_name"))
    return reg.join_station_metadata(obs, t.v_stations.select("station_id", "station_name", "state", "latitude"))


_CITY_VALUES = ", ".join(f"('{c}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for c, (a, b) in V.CITY_COORDINATES.items())


@query("city_coord_lookup", f"""WITH c(k, city_lat, city_lon) AS (VALUES {_CITY_VALUES})
SELECT station_id, city, city_lat, city_lon FROM {{v_stations}} LEFT JOIN c ON k = lower(trim(city))""")
def city_coord_lookup(t):
    return reg.city_coordinates(t.v_stations.select("station_id", "city"))


_SRC_A = "SELECT o_orderkey AS ordinal, 'St ' || CAST(o_custkey AS STRING) AS station, CASE WHEN o_custkey % 4 = 0 THEN 'Delhi' WHEN o_custkey % 4 = 1 THEN 'Pune' ELSE 'Nowhere' END AS city, o_orderpriority AS state, CAST(o_orderdate AS TIMESTAMP) AS last_update FROM {orders} WHERE o_orderstatus <> 'F'"
_SRC_B = "SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS ordinal, 'St ' || CAST(l_suppkey * 7 AS STRING) AS station, 'B town' AS city, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS latitude, CASE WHEN l_linenumber = 2 THEN NULL ELSE 68 + l_discount * 10 END AS longitude, CAST(l_shipdate AS TIMESTAMP) AS utc_time FROM {lineitem}"


@query("consolidate_stations", f"""WITH a0 AS ({_SRC_A}), b0 AS ({_SRC_B}), c(k, clat, clon) AS (VALUES {_CITY_VALUES}),
a AS (SELECT station, city, state, last_update, clat, clon FROM (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY station ORDER BY ordinal DESC) = 1) LEFT JOIN c ON k = lower(trim(city))),
bf AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY station ORDER BY ordinal, city, utc_time, latitude NULLS FIRST, longitude NULLS FIRST) = 1),
bk AS (SELECT * FROM b0 WHERE latitude IS NOT NULL AND longitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station ORDER BY ordinal DESC, latitude DESC, longitude DESC) = 1),
j AS (SELECT coalesce(a.station, bf.station) AS station_name, a.station IS NOT NULL AS ina, bf.station IS NOT NULL AS inb, a.city AS acity, bf.city AS bcity, a.state AS astate,
 clat, clon, bk.latitude AS klat, bk.longitude AS klon, bf.latitude AS blat, bf.longitude AS blon, a.last_update, bf.utc_time
 FROM a FULL OUTER JOIN bf ON a.station = bf.station LEFT JOIN bk ON bk.station = bf.station)
SELECT printf('STN_%03d', row_number() OVER (ORDER BY station_name)) AS station_id, station_name, CASE WHEN ina THEN acity ELSE bcity END AS city,
 CASE WHEN ina THEN astate ELSE '' END AS state, {sql_r('CASE WHEN ina THEN coalesce(klat, clat) ELSE coalesce(klat, blat) END')} AS latitude,
 {sql_r('CASE WHEN ina THEN coalesce(klon, clon) ELSE coalesce(klon, blon) END')} AS longitude,
 CASE WHEN ina AND inb THEN 'CPCB, OpenAQ' WHEN ina THEN 'CPCB' ELSE 'OpenAQ' END AS source, CASE WHEN ina THEN last_update ELSE utc_time END AS last_updated FROM j""")
def consolidate_stations(t):
    a = t.spark.sql(_SRC_A, orders=t.orders)
    b = t.spark.sql(_SRC_B, lineitem=t.lineitem)
    out = reg.consolidate(a, b)
    return out.withColumns({"latitude": r("latitude"), "longitude": r("longitude")})


_LOOKUP = """idm AS (SELECT lower(trim(coalesce(station_id, ''))) AS k, * FROM {v_official} WHERE lower(trim(coalesce(station_id, ''))) <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ordinal DESC) = 1),
nmm AS (SELECT lower(trim(coalesce(station_name, ''))) AS kn, lower(trim(coalesce(city, ''))) AS kc, * FROM {v_official} WHERE lower(trim(coalesce(station_name, ''))) <> '' QUALIFY row_number() OVER (PARTITION BY kn, kc ORDER BY ordinal DESC) = 1),
lk AS (SELECT r.*, coalesce(idm.ordinal, nmm.ordinal) AS off_ordinal FROM {v_registry} r LEFT JOIN idm ON idm.k = lower(trim(coalesce(r.station_id, '')))
 LEFT JOIN nmm ON nmm.kn = lower(trim(coalesce(r.station_name, ''))) AND nmm.kc = lower(trim(coalesce(r.city, '')))),
o AS (SELECT lk.*, f.station_id AS oid, f.station_name AS oname, f.city AS ocity, f.state AS ostate, f.latitude AS olat, f.longitude AS olon FROM lk LEFT JOIN {v_official} f ON f.ordinal = lk.off_ordinal),
mm AS (SELECT *, CASE WHEN off_ordinal IS NULL THEN '' ELSE concat_ws('|',
  CASE WHEN lower(trim(coalesce(station_id, ''))) <> lower(trim(coalesce(oid, ''))) THEN 'station_id' END,
  CASE WHEN lower(trim(coalesce(station_name, ''))) <> lower(trim(coalesce(oname, ''))) THEN 'station_name' END,
  CASE WHEN lower(trim(coalesce(city, ''))) <> lower(trim(coalesce(ocity, ''))) THEN 'city' END,
  CASE WHEN lower(trim(coalesce(state, ''))) <> lower(trim(coalesce(ostate, ''))) THEN 'state' END,
  CASE WHEN abs(TRY_CAST(latitude AS DOUBLE) - olat) > 0.01 THEN 'latitude' END,
  CASE WHEN abs(TRY_CAST(longitude AS DOUBLE) - olon) > 0.01 THEN 'longitude' END) END AS mismatch_fields,
  count(*) OVER (PARTITION BY station_name, city, state) > 1 AS is_duplicate FROM o)"""

_WARN = """concat_ws('; ', CASE WHEN trim(coalesce(latitude, '')) = '' THEN 'missing_latitude' END, CASE WHEN trim(coalesce(longitude, '')) = '' THEN 'missing_longitude' END,
 CASE WHEN trim(coalesce(city, '')) = '' THEN 'missing_city' END, CASE WHEN trim(coalesce(state, '')) = '' THEN 'missing_state' END,
 CASE WHEN is_duplicate THEN 'duplicate_station' END, CASE WHEN TRY_CAST(latitude AS DOUBLE) NOT BETWEEN -90 AND 90 THEN 'invalid_latitude_range' END,
 CASE WHEN TRY_CAST(longitude AS DOUBLE) NOT BETWEEN -180 AND 180 THEN 'invalid_longitude_range' END{})"""


@query("official_lookup_join", f"WITH {_LOOKUP} SELECT ordinal, station_id, oid, oname, ostate FROM o")
def official_lookup_join(t):
    out = reg.official_lookup(t.v_registry, t.v_official)
    return out.select("ordinal", "station_id", F.col("official.station_id").alias("oid"),
                      F.col("official.station_name").alias("oname"), F.col("official.state").alias("ostate"))


@query("duplicate_station_flag", "SELECT ordinal, count(*) OVER (PARTITION BY station_name, city, state) > 1 AS is_duplicate FROM {v_registry}")
def duplicate_station_flag(t):
    return reg.flag_duplicates(t.v_registry).select("ordinal", "is_duplicate")


@query("station_field_warnings", f"""WITH d AS (SELECT *, count(*) OVER (PARTITION BY station_name, city, state) > 1 AS is_duplicate FROM {{v_registry}})
SELECT ordinal, {_WARN.format('')} AS warnings FROM d""")
def station_field_warnings(t):
    flagged = reg.flag_duplicates(t.v_registry)
    return flagged.select("ordinal", F.concat_ws("; ", reg.field_warnings(F.col("is_duplicate"))).alias("warnings"))


@query("official_mismatch", f"WITH {_LOOKUP} SELECT ordinal, off_ordinal IS NOT NULL AS matched, mismatch_fields FROM mm")
def official_mismatch(t):
    out = reg.official_lookup(t.v_registry, t.v_official)
    return out.select("ordinal", F.col("official").isNotNull().alias("matched"), reg.mismatched_fields().alias("mismatch_fields"))


_CHECKED = f"""WITH {_LOOKUP}, checked AS (SELECT ordinal, station_id, station_name, city, state, latitude, longitude,
 {_WARN.format(", CASE WHEN off_ordinal IS NULL THEN 'official_station_not_matched' WHEN mismatch_fields <> '' THEN 'official_metadata_mismatch:' || mismatch_fields END")} AS warnings, mismatch_fields FROM mm)"""


@query("station_flow", f"{_CHECKED} SELECT * FROM checked")
def station_flow(t):
    return reg.check_registry(t.v_registry, t.v_official)


@query("station_flow_totals", f"""{_CHECKED} SELECT count(*) AS n_stations, count(*) FILTER (WHERE warnings <> '') AS with_warnings,
 count(*) FILTER (WHERE warnings LIKE '%invalid_latitude_range%' OR warnings LIKE '%invalid_longitude_range%') AS invalid_coordinates,
 count(*) FILTER (WHERE mismatch_fields <> '') AS mismatches FROM checked""")
def station_flow_totals(t):
    return reg.registry_totals(reg.check_registry(t.v_registry, t.v_official))
