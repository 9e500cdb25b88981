"""Fill strategies, splits, profiles, checks, correlations and model scoring tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroframe import values as V
from aeroframe.catalog.registry import query, r, sql_r
from aeroframe.operators import fill, profile, quality, scoring, split
from aeroframe.plans import flows

_F = ["pm25", "pm10", "no2", "so2", "temperature", "surface_pressure", "aod", "relative_humidity"]
_FULL = ["pm25", "pm10", "no2", "so2", "temperature", "relative_humidity"]

# -- fills ---------------------------------------------------------------------------------------

_W = "PARTITION BY station_id ORDER BY ts NULLS LAST, ordinal"


def _placed(filled: str, c: str) -> str:
    """A fill's value, for rows that have a station."""
    return f"CASE WHEN station_id IS NULL THEN {c} ELSE {filled} END"


def _last(c: str) -> str:
    return _placed(f"last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", c)


@query("fill_forward", f"SELECT ordinal, station_id, {_last('pm25')} AS pm25, {_last('temperature')} AS temperature FROM {{v_series}}")
def fill_forward(t):
    return fill.forward_fill(t.v_series, ["pm25", "temperature"]).select("ordinal", "station_id", "pm25", "temperature")


def _interp(c: str) -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN p_{c} IS NULL THEN n_{c}.v WHEN n_{c} IS NULL THEN p_{c}.v "
            f"ELSE p_{c}.v + (n_{c}.v - p_{c}.v) * (pos - p_{c}.p) / (n_{c}.p - p_{c}.p) END")


@query("fill_interpolate", f"""WITH z AS (SELECT *, row_number() OVER ({_W}) AS pos FROM {{v_series}}),
k AS (SELECT *, {', '.join(f'''last_value(CASE WHEN {c} IS NOT NULL THEN struct_pack(p := pos, v := {c}) END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_{c},
 first_value(CASE WHEN {c} IS NOT NULL THEN struct_pack(p := pos, v := {c}) END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{c}''' for c in ('pm25', 'temperature'))} FROM z)
SELECT ordinal, station_id, {sql_r(_placed(_interp('pm25'), 'pm25'))} AS pm25, {sql_r(_placed(_interp('temperature'), 'temperature'))} AS temperature FROM k""")
def fill_interpolate(t):
    out = fill.interpolate(t.v_series, ["pm25", "temperature"])
    return out.select("ordinal", "station_id", r("pm25").alias("pm25"), r("temperature").alias("temperature"))


@query("fill_station_median", f"""WITH m AS (SELECT station_id, median(pm25) AS a, median(temperature) AS b FROM {{v_series}} GROUP BY 1)
SELECT ordinal, s.station_id, {sql_r('coalesce(pm25, a)')} AS pm25, {sql_r('coalesce(temperature, b)')} AS temperature FROM {{v_series}} s LEFT JOIN m ON m.station_id = s.station_id""")
def fill_station_median(t):
    out = fill.station_median(t.v_series, ["pm25", "temperature"])
    return out.select("ordinal", "station_id", r("pm25").alias("pm25"), r("temperature").alias("temperature"))


@query("mean_zero_fill", "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _F) + " FROM {v_features}) SELECT "
       + ", ".join(f"{sql_r(f'coalesce({c}, m_{c}, 0)')} AS {c}" for c in _F) + ", aqi FROM {v_features}, m")
def mean_zero_fill(t):
    out = fill.mean_zero_fill(t.v_features.select(*_F, "aqi"), _F)
    return out.withColumns({c: r(c) for c in _F})


@query("drop_all_null_columns", "WITH x AS (SELECT * FROM {v_features} WHERE aqi IS NOT NULL), m AS (SELECT "
       + ", ".join(f"median({c}) AS m_{c}" for c in _F if c != "aod") + " FROM x) SELECT "
       + ", ".join(f"{sql_r(f'coalesce({c}, m_{c})')} AS {c}" for c in _F if c != "aod") + ", aqi FROM x, m")
def drop_all_null_columns(t):
    out = profile.prepared_features(t.v_features.select(*_F, "aqi"), _F, "aqi")
    return out.withColumns({c: r(c) for c in out.columns if c != "aqi"})


# -- splits --------------------------------------------------------------------------------------


@query("chronological_split", """WITH n AS (SELECT count(*) AS n FROM {v_obs_long}), o AS (SELECT ordinal, row_number() OVER (ORDER BY ts, ordinal) AS rn FROM {v_obs_long})
SELECT ordinal, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM o, n""")
def chronological_split(t):
    return split.chronological_split(t.v_obs_long, "ts", "ordinal").select("ordinal", "split")


@query("split_summary", """WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
s AS (SELECT CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split, n FROM o, n)
SELECT split, count(*) AS n_rows, """ + sql_r("count(*) / max(n)") + " AS ratio FROM s GROUP BY split")
def split_summary(t):
    out = split.split_summary(split.chronological_split(t.orders, "o_orderdate", "o_orderkey"))
    return out.withColumn("ratio", r("ratio"))


@query("temporal_holdout_split", """WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_orderkey, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM o, n""")
def temporal_holdout_split(t):
    return split.holdout_split(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query("random_holdout_split", "SELECT CASE WHEN g = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN g = 0 THEN CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) ELSE n - CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) END AS n_rows FROM (SELECT count(*) AS n FROM orders), range(2) t(g)")
def random_holdout_split(t):
    return split.random_split(t.orders, "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


# -- profiles ------------------------------------------------------------------------------------


def _rows(cols_, template: str) -> str:
    return " UNION ALL ".join(template.replace("<c>", c) for c in cols_)


_DICT = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in V.FEATURE_DICTIONARY)


@query("null_profile", f"""WITH d(column_name, description, unit, source) AS (VALUES {_DICT}),
p AS ({_rows(_F, "SELECT '<c>' AS column_name, count(*) - count(<c>) AS n_null, " + sql_r('round_even((count(*) - count(<c>)) / count(*) * 100, 2)') + " AS null_pct FROM {v_features}")})
SELECT p.column_name, n_null, null_pct, description, unit, source FROM p LEFT JOIN d ON d.column_name = p.column_name""")
def null_profile(t):
    return profile.null_profile(t.v_features, _F).withColumn("null_pct", r("null_pct"))


@query("feature_summary", "SELECT count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, CAST(12 AS BIGINT) AS n_columns FROM {v_features}")
def feature_summary(t):
    return profile.feature_summary(t.v_features)


@query("describe_all", _rows(_F, "SELECT '<c>' AS column_name, count(<c>) AS n, " + ", ".join(
    f"{sql_r(e)} AS {n}" for n, e in (("mean", "avg(<c>)"), ("std", "stddev_samp(<c>)"), ("\"min\"", "min(<c>)"), ("\"max\"", "max(<c>)"),
                                      ("q25", "quantile_cont(<c>, 0.25)"), ("q50", "quantile_cont(<c>, 0.5)"), ("q75", "quantile_cont(<c>, 0.75)")))
    + " FROM {v_features}"))
def describe_all(t):
    out = profile.describe_numeric(t.v_features, _F)
    return out.select("column_name", "n", *[r(c).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")])


_TXT = ["o_orderstatus", "o_orderpriority"]


@query("describe_text", _rows(_TXT, """SELECT '<c>' AS column_name, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_unique, arg_min(v, struct_pack(k := -k, v := v)) AS "top", max(k) AS freq
 FROM (SELECT <c> AS v, count(*) AS k FROM orders GROUP BY 1)"""))
def describe_text(t):
    return profile.describe_text(t.orders, _TXT)


@query("dataset_summary", "SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_features, 'aqi' AS target, CAST(sum("
       + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in [*_F, "aqi"]) + ") AS BIGINT) AS n_null_cells FROM {v_features}")
def dataset_summary(t):
    return profile.dataset_summary(t.v_features.select(*_F, "aqi"), "aqi")


@query("variance_filter", _rows(_F, "SELECT '<c>' AS column_name, " + sql_r("var_samp(<c>)", 3) + " AS variance, coalesce(var_samp(<c>) <= 0, true) AS dropped FROM {v_features}"))
def variance_filter(t):
    return profile.variances(t.v_features, _F).withColumn("variance", r("variance", 3))


_FILLED = "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in [*_F, "aqi"]) + " FROM {v_features}), f AS (SELECT " + ", ".join(
    f"coalesce({c}, m_{c}, 0) AS {c}" for c in [*_F, "aqi"]) + " FROM {v_features}, m)"


@query("correlation_matrix", f"{_FILLED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {sql_r(f'corr({a}, {b})')} AS r FROM f" for a in _FULL for b in _FULL))
def correlation_matrix(t):
    return profile.correlation_matrix(t.v_features, _F).withColumn("r", r("r"))


@query("feature_target_corr", f"{_FILLED} " + _rows(_FULL, "SELECT '<c>' AS feature, " + sql_r("corr(<c>, aqi)") + " AS r FROM f"))
def feature_target_corr(t):
    return profile.target_correlations(t.v_features, _F, "aqi").withColumn("r", r("r"))


_PAIRS = [(a, b) for i, a in enumerate(_FULL) for b in _FULL[i + 1:]]


# pm25 and temperature are the only near-collinear pair: the one less correlated with aqi goes
@query("collinear_prune", "WITH g AS (SELECT CASE WHEN abs(corr(pm25, temperature)) < 0.95 THEN '' WHEN abs(corr(pm25, aqi)) < abs(corr(temperature, aqi)) THEN 'pm25' ELSE 'temperature' END AS gone FROM {v_features}), p AS ("
       + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS x FROM {{v_features}}" for a, b in _PAIRS)
       + f") SELECT feature_a, feature_b, {sql_r('x')} AS r, abs(x) < 0.95 AS apart FROM p, g WHERE gone NOT IN (feature_a, feature_b)")
def collinear_prune(t):
    gone = profile.collect_collinear_drops(t.v_features, _FULL, "aqi", 0.95)
    pairs = [(a, b) for a, b in _PAIRS if a not in gone and b not in gone]
    return profile.correlations(t.v_features, pairs).select(
        "feature_a", "feature_b", r("r").alias("r"), (F.abs("r") < 0.95).alias("apart"))


_RANKED = f"""{_FILLED}, c AS ({_rows(_FULL, "SELECT '<c>' AS feature, corr(<c>, aqi) AS r, abs(corr(<c>, pm25)) AS importance FROM f")}),
k AS (SELECT feature, r, abs(r) AS abs_r, importance, rank() OVER (ORDER BY round(abs(r), 9) DESC) AS r_rank, rank() OVER (ORDER BY round(importance, 9) DESC) AS importance_rank FROM c),
ranking AS (SELECT *, (r_rank + importance_rank) / 2.0::DOUBLE AS combined, rank() OVER (ORDER BY r_rank + importance_rank) AS final_rank FROM k)"""
_RANK_COLS = f"feature, {sql_r('r')} AS r, CAST(r_rank AS INTEGER) AS r_rank, CAST(importance_rank AS INTEGER) AS importance_rank, combined, CAST(final_rank AS INTEGER) AS final_rank"


def _ranking(t):
    against = profile.target_correlations(t.v_features, _F, "aqi")
    stand_in = profile.target_correlations(t.v_features, _F, "pm25").select("feature", F.round(F.abs("r"), 9).alias("importance"))
    joined = against.join(stand_in, "feature").withColumn("r", F.round("r", 9))
    return profile.rank_features(joined)


@query("rank_features", f"{_RANKED} SELECT {_RANK_COLS} FROM ranking")
def rank_features(t):
    return _ranking(t).select("feature", r("r").alias("r"), "r_rank", "importance_rank", "combined", "final_rank")


@query("collinear_pairs", f"""{_RANKED}, mx AS ({' UNION ALL '.join(f"SELECT '{min(a, b)}' AS feature_a, '{max(a, b)}' AS feature_b, corr({a}, {b}) AS r FROM f" for a, b in _PAIRS)})
SELECT feature_a, feature_b, {sql_r('mx.r')} AS r, CASE WHEN a.final_rank <= b.final_rank THEN feature_a ELSE feature_b END AS keep,
 CASE WHEN a.final_rank <= b.final_rank THEN feature_b ELSE feature_a END AS "drop" FROM mx JOIN ranking a ON a.feature = feature_a JOIN ranking b ON b.feature = feature_b WHERE abs(mx.r) >= 0.8""")
def collinear_pairs(t):
    pairs = profile.collinear_pairs(profile.correlation_matrix(t.v_features, _F), _ranking(t))
    return pairs.select("feature_a", "feature_b", r("r").alias("r"), "keep", "drop")


@query("feature_selection_flow", f"""{_FILLED}, c AS ({_rows(_FULL, "SELECT '<c>' AS feature, corr(<c>, aqi) AS r FROM f")}),
k AS (SELECT feature, r, abs(r) AS abs_r, rank() OVER (ORDER BY abs(r) DESC) AS r_rank FROM c),
ranking AS (SELECT *, rank() OVER (ORDER BY r_rank) AS final_rank FROM k),
mx AS ({' UNION ALL '.join(f"SELECT '{min(a, b)}' AS feature_a, '{max(a, b)}' AS feature_b, corr({a}, {b}) AS r FROM f" for a, b in _PAIRS)}),
p AS (SELECT CASE WHEN a.final_rank <= b.final_rank THEN feature_b ELSE feature_a END AS feature FROM mx JOIN ranking a ON a.feature = feature_a JOIN ranking b ON b.feature = feature_b WHERE abs(mx.r) >= 0.8)
SELECT k.feature, {sql_r('k.r')} AS r, CAST(ranking.final_rank AS INTEGER) AS final_rank, (SELECT count(*) FROM p WHERE p.feature = k.feature) AS n_collinear FROM k JOIN ranking ON ranking.feature = k.feature""")
def feature_selection_flow(t):
    out = flows.feature_selection(t.v_features, _F, "aqi")
    return out.select("feature", r("r").alias("r"), "final_rank", "n_collinear")


# -- checks --------------------------------------------------------------------------------------


_MERGED_COLS = ["station_id", "station_name", "city", "state", "latitude", "longitude", "date", "time", "pm25", "pm10", "no2", "so2", "co", "o3",
                "satellite_match_distance_km", "era5_match_distance_km", "aqi"]


@query("validate_missing", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS n_null, {sql_r(f'round_even((count(*) - count("{c}")) / count(*) * 100, 4)')} AS null_pct,
 CASE WHEN {'true' if c in V.CRITICAL_COLUMNS else 'false'} AND count(*) > count("{c}") THEN 'FAILED' WHEN (count(*) - count("{c}")) / count(*) > 0.2 THEN 'WARNING' ELSE 'PASSED' END AS status FROM {{v_merged}}"""
    for c in _MERGED_COLS))
def validate_missing(t):
    return quality.missing_values_check(t.v_merged.select(*_MERGED_COLS)).withColumn("null_pct", r("null_pct"))


_NOW = "2000-01-01 00:00:00"
_STAMPS = f"""count(*) FILTER (WHERE "date" = 'someday') AS bad_date, count(*) FILTER (WHERE "time" = '25:00:00') AS bad_time,
 count(*) FILTER (WHERE "date" <> 'someday' AND "time" <> '25:00:00' AND TRY_CAST("date" || ' ' || "time" AS TIMESTAMP) > TIMESTAMP '{_NOW}' + INTERVAL '1' HOUR) AS in_future"""


@query("validate_timestamps", f"SELECT *, CASE WHEN bad_date + bad_time + in_future > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM (SELECT {_STAMPS} FROM {{v_merged}})")
def validate_timestamps(t):
    return quality.timestamps_check(t.v_merged, F.lit(_NOW).cast("timestamp"))


_LAT, _LON = "TRY_CAST(latitude AS DOUBLE)", "TRY_CAST(longitude AS DOUBLE)"
_WORLD = f"coalesce({_LAT} BETWEEN -90 AND 90 AND {_LON} BETWEEN -180 AND 180, false)"
_COORDS = f"""count(*) FILTER (WHERE NOT {_WORLD}) AS invalid, count(*) FILTER (WHERE {_WORLD} AND NOT ({_LAT} BETWEEN 6 AND 38 AND {_LON} BETWEEN 68 AND 98)) AS outside_region"""


@query("validate_coordinates", f"SELECT *, CASE WHEN invalid > 0 THEN 'FAILED' WHEN outside_region > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM (SELECT {_COORDS} FROM {{v_merged}})")
def validate_coordinates(t):
    return quality.coordinates_check(t.v_merged)


@query("validate_table", f"""WITH b AS (SELECT {', '.join(f'"{c}"' for c in _MERGED_COLS)} FROM {{v_merged}}),
one AS (SELECT count(*) AS n, {_STAMPS}, {_COORDS}, {', '.join(f'count("{c}") AS n_{c}' for c in _MERGED_COLS)} FROM b),
c AS (SELECT 'required_columns' AS "check", 'WARNING' AS status, CAST(16 AS BIGINT) AS n_found
 UNION ALL SELECT 'dtypes', 'FAILED', 2
 UNION ALL SELECT 'missing_values', CASE WHEN n_latitude < n OR n_longitude < n THEN 'FAILED' ELSE 'PASSED' END, CAST(n_latitude < n AS BIGINT) + CAST(n_longitude < n AS BIGINT) FROM one
 UNION ALL SELECT 'timestamps', CASE WHEN bad_date + bad_time + in_future > 0 THEN 'FAILED' ELSE 'PASSED' END, bad_date + bad_time + in_future FROM one
 UNION ALL SELECT 'coordinates', CASE WHEN invalid > 0 THEN 'FAILED' ELSE 'PASSED' END, invalid FROM one
 UNION ALL SELECT 'duplicate_rows', CASE WHEN d > 0 THEN 'FAILED' ELSE 'PASSED' END, d FROM (SELECT (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS d)
 UNION ALL SELECT 'duplicate_station_time', CASE WHEN d > 0 THEN 'FAILED' ELSE 'PASSED' END, d FROM (SELECT (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT station_id, "date", "time" FROM b)) AS d))
SELECT * FROM c UNION ALL SELECT 'overall', CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED' ELSE 'WARNING' END, count(*) FILTER (WHERE status <> 'PASSED') FROM c""")
def validate_table(t):
    return quality.validate_table(t.v_merged.select(*_MERGED_COLS), F.lit(_NOW).cast("timestamp"))


def _range_sql() -> str:
    have = set(_F) | {"station_id", "weekend_flag", "season", "aqi"}
    rows = []
    for c, _, group, kind, _, _, lo, hi in V.FEATURES:
        here = c in have
        pct = sql_r(f"round_even((count(*) - count({c})) / count(*) * 100, 2)") if here else "CAST(NULL AS DOUBLE)"
        off = f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi})" if here and kind == "numeric" else "CAST(0 AS BIGINT)"
        rows.append(f"SELECT '{c}' AS feature, '{group}' AS feature_group, {str(here).lower()} AS present, {pct} AS null_pct, {off} AS out_of_range, CAST(0 AS BIGINT) AS type_mismatch, 'PASSED' AS status" + (" FROM {v_features}" if here else ""))
    return " UNION ALL ".join(rows)


@query("feature_range_check", _range_sql())
def feature_range_check(t):
    return quality.feature_range_check(t.v_features).withColumn("null_pct", r("null_pct"))


@query("target_stage_check", """SELECT 'raw' AS stage, false AS present, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_known, count(*) AS n_null, 'ERROR' AS status FROM {v_raw}
UNION ALL SELECT 'merged', true, count(*), count(aqi), count(*) - count(aqi), 'OK' FROM {v_merged}
UNION ALL SELECT 'features', true, count(*), count(aqi), count(*) - count(aqi), 'OK' FROM {v_features}""")
def target_stage_check(t):
    return quality.target_stages({"raw": t.v_raw, "merged": t.v_merged, "features": t.v_features})


def _lineage_sql(tail: str) -> str:
    reg = ", ".join(f"('{f}', '{c}', {str(p).lower()}, {str(u).lower()})" for f, c, p, u in V.LINEAGE)
    have = lambda table, names: " UNION ALL ".join(f"SELECT '{n}' AS f, count({n}) AS k FROM {table}" for n in names)
    return f"""WITH reg(feature, category, pending, used_by_model) AS (VALUES {reg}),
raw AS ({have('{v_raw}', ['pm25', 'pm10', 'no2', 'so2'])}), merged AS ({have('{v_features}', [*_F, 'season', 'weekend_flag'])}), ana AS ({have('{v_merged}', ['pm25', 'pm10', 'no2', 'so2', 'co', 'o3'])}),
j AS (SELECT reg.*, raw.k AS raw_k, merged.k AS merged_k, ana.k AS ana_k, category = 'Satellite' AS waits FROM reg LEFT JOIN raw ON raw.f = feature LEFT JOIN merged ON merged.f = feature LEFT JOIN ana ON ana.f = feature),
s AS (SELECT *, CASE WHEN pending THEN 'Pending Implementation' WHEN waits OR ana_k IS NULL THEN 'Waiting for Data' ELSE 'Available' END AS status,
 CASE WHEN pending THEN 'PENDING' WHEN coalesce(ana_k, 0) > 0 THEN 'PASS' ELSE 'FAIL' END AS ana_p FROM j),
audit AS (SELECT feature, category, status, used_by_model, CASE WHEN category = 'Pollutant' THEN CASE WHEN coalesce(raw_k, 0) > 0 THEN 'PASS' ELSE 'FAIL' END WHEN pending THEN 'PENDING' ELSE 'N/A' END AS raw_stage,
 CASE WHEN category = 'Pollutant' THEN CASE WHEN coalesce(raw_k, 0) > 0 THEN 'PASS' ELSE 'FAIL' END WHEN pending THEN 'PENDING' ELSE 'N/A' END AS cleaned_stage,
 CASE WHEN waits AND merged_k = 0 THEN 'WAITING' WHEN pending THEN 'PENDING' WHEN coalesce(merged_k, 0) > 0 THEN 'PASS' ELSE 'FAIL' END AS features_stage,
 CASE WHEN ana_p = 'FAIL' AND status = 'Waiting for Data' THEN 'WAITING' ELSE ana_p END AS builder_stage,
 CASE WHEN ana_p = 'FAIL' AND status = 'Waiting for Data' THEN 'WAITING' ELSE ana_p END AS analysis_stage,
 CASE WHEN pending THEN 'PENDING' WHEN NOT used_by_model THEN 'N/A' WHEN status = 'Waiting for Data' THEN 'WAITING' ELSE 'PASS' END AS model_stage FROM s)
{tail}"""


def _audit(t):
    return quality.lineage_audit(t.spark, t.v_raw, t.v_raw, t.v_features, t.v_merged, None, False, True)


@query("lineage_audit", _lineage_sql("SELECT * FROM audit"))
def lineage_audit(t):
    return _audit(t)


@query("lineage_totals", _lineage_sql("SELECT status, count(*) AS n_features, count(*) FILTER (WHERE used_by_model AND status = 'Available') AS n_reaching_model FROM audit GROUP BY status"))
def lineage_totals(t):
    return quality.lineage_totals(_audit(t))


def _pretrain_sql() -> str:
    have = set(_F) | {"season", "weekend_flag"}
    rows = []
    for f, _, pending, used in V.LINEAGE:
        if pending:
            rows.append(f"SELECT '{f}' AS feature, 'INFO' AS \"level\", 'pending' AS issue, true AS shown")
        elif used and f not in have:
            rows.append(f"SELECT '{f}', 'ERROR', 'missing', true")
        elif used:
            rows.append(f"SELECT '{f}', 'ERROR', 'all_null', count({f}) = 0 FROM {{v_features}}")
    return f"WITH x(feature, \"level\", issue, shown) AS ({' UNION ALL '.join(rows)}) SELECT feature, \"level\", issue FROM x WHERE shown"


@query("pretrain_check", _pretrain_sql())
def pretrain_check(t):
    return quality.pretrain_check(t.v_features)


# -- scoring -------------------------------------------------------------------------------------

_ERR = "(predicted - actual)"
_MET = f"""sqrt(avg({_ERR} * {_ERR})) AS rmse, avg(abs{_ERR}) AS mae, 1 - avg({_ERR} * {_ERR}) / var_pop(actual) AS r2"""


@query("regression_metrics", f"SELECT model, n, {sql_r('r2')} AS r2, {sql_r('rmse', 3)} AS rmse, {sql_r('mae', 3)} AS mae, {sql_r('mbe', 3)} AS mbe FROM (SELECT model, count(*) AS n, {_MET}, avg({_ERR}) AS mbe FROM {{v_predictions}} GROUP BY model)")
def regression_metrics(t):
    out = scoring.regression_metrics(t.v_predictions, ["model"])
    return out.select("model", "n", r("r2").alias("r2"), *[r(c, 3).alias(c) for c in ("rmse", "mae", "mbe")])


@query("residual_analysis", f"""SELECT model, count(*) AS n, {sql_r('avg(abs(actual - predicted))', 3)} AS mae, {sql_r('avg((actual - predicted) * (actual - predicted))', 1)} AS mse,
 {sql_r('sqrt(avg((actual - predicted) * (actual - predicted)))', 3)} AS rmse, {sql_r('avg(actual - predicted)', 3)} AS mean_residual, {sql_r('stddev_samp(actual - predicted)', 3)} AS std_residual FROM {{v_predictions}} GROUP BY model""")
def residual_analysis(t):
    out = scoring.residual_summary(scoring.with_residuals(t.v_predictions), ["model"])
    return out.select("model", "n", r("mse", 1).alias("mse"), *[r(c, 3).alias(c) for c in ("mae", "rmse", "mean_residual", "std_residual")])


_FOLDS = f"""folds AS (SELECT model, fold, CASE WHEN model = 'N' AND fold = 2 THEN CAST('inf' AS DOUBLE) ELSE rmse END AS rmse, mae, r2
 FROM (SELECT model, fold, {_MET} FROM {{v_predictions}} GROUP BY model, fold))"""


def _folds(t):
    scored = scoring.regression_metrics(t.v_predictions, ["model", "fold"])
    broken = (F.col("model") == "N") & (F.col("fold") == 2)
    return scored.select("model", "fold", F.when(broken, F.lit(float("inf"))).otherwise(F.col("rmse")).alias("rmse"), "mae", "r2")


def _finite(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


@query("cv_summary", f"WITH {_FOLDS} SELECT model, " + ", ".join(
    f"{sql_r(f'avg({_finite(m)})', 3)} AS {m}_mean, {sql_r(f'coalesce(stddev_samp({_finite(m)}), 0)', 3)} AS {m}_std" for m in ("rmse", "mae", "r2")) + " FROM folds GROUP BY model")
def cv_summary(t):
    out = scoring.cv_summary(_folds(t))
    return out.select("model", *[r(c, 3).alias(c) for c in out.columns if c != "model"])


@query("prediction_summary", f"SELECT model, count(predicted) AS n, {sql_r('avg(predicted)', 3)} AS mean, min(predicted) AS \"min\", max(predicted) AS \"max\", {sql_r('stddev_samp(predicted)', 3)} AS std FROM {{v_predictions}} GROUP BY model")
def prediction_summary(t):
    out = scoring.prediction_summary(t.v_predictions, by=["model"])
    return out.withColumns({"mean": r("mean", 3), "std": r("std", 3)})


_RESULTS = f"results AS (SELECT model, rmse, mae, CASE WHEN model = 'R' THEN NULL ELSE r2 END AS r2 FROM (SELECT model, {_MET} FROM {{v_predictions}} GROUP BY model))"


def _results(t):
    return scoring.regression_metrics(t.v_predictions, ["model"]).select(
        "model", "rmse", "mae", F.when(F.col("model") != "R", F.col("r2")).alias("r2"))


@query("rank_models", f"""WITH {_RESULTS}, k AS (SELECT model, rank() OVER (ORDER BY coalesce(rmse, 'inf')) AS rmse_rank, rank() OVER (ORDER BY coalesce(r2, '-inf') DESC) AS r2_rank FROM results)
SELECT model, CAST(rmse_rank AS INTEGER) AS rmse_rank, CAST(r2_rank AS INTEGER) AS r2_rank, (rmse_rank + r2_rank) / 2.0::DOUBLE AS combined, CAST(rank() OVER (ORDER BY rmse_rank + r2_rank) AS INTEGER) AS final_rank FROM k""")
def rank_models(t):
    return scoring.rank_models(_results(t)).select("model", "rmse_rank", "r2_rank", "combined", "final_rank")


@query("rank_tuned_models", f"WITH {_RESULTS} SELECT model, CAST(rank() OVER (ORDER BY CASE WHEN model = 'A' THEN CAST('inf' AS DOUBLE) ELSE rmse END) AS INTEGER) AS final_rank FROM results")
def rank_tuned_models(t):
    tuned = _results(t).select("model", F.when(F.col("model") != "A", F.col("rmse")).alias("best_rmse"))
    return scoring.rank_tuned(tuned).select("model", "final_rank")


_SCORES = f"""WITH {_RESULTS}, {_FOLDS}, cv AS (SELECT model, avg({_finite('rmse')}) AS x FROM folds GROUP BY model), opt AS (SELECT model, rmse * 0.9 AS x FROM results WHERE model <> 'A'),
j AS (SELECT r.model, r.rmse AS b, cv.x AS c, opt.x AS o FROM results r LEFT JOIN cv ON cv.model = r.model LEFT JOIN opt ON opt.model = r.model),
w AS (SELECT *, CASE WHEN b IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN o IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END AS tot FROM j),
s AS (SELECT *, (coalesce(b * 0.2::DOUBLE, 0) + coalesce(c * 0.4::DOUBLE, 0) + coalesce(o * 0.4::DOUBLE, 0)) / tot AS score FROM w),
final AS (SELECT *, rank() OVER (ORDER BY score) AS k FROM s)"""


def _scores(t):
    tuned = _results(t).where("model <> 'A'").select("model", (F.col("rmse") * 0.9).alias("best_rmse"))
    return scoring.score_candidates(_results(t), _folds(t), tuned)


@query("score_candidates", f"{_SCORES} SELECT model, {sql_r('score', 3)} AS score, {sql_r('0.2::DOUBLE / tot')} AS baseline_weight, {sql_r('CASE WHEN o IS NOT NULL THEN 0.4::DOUBLE / tot ELSE 0 END')} AS optimized_weight, CAST(k AS INTEGER) AS final_rank FROM final")
def score_candidates(t):
    return _scores(t).select("model", r("score", 3).alias("score"), r("baseline_weight").alias("baseline_weight"),
                             r("optimized_weight").alias("optimized_weight"), "final_rank")


@query("select_model", f"{_SCORES} SELECT model, CAST(k AS INTEGER) AS final_rank FROM final ORDER BY k, model LIMIT 1")
def select_model(t):
    return scoring.select_model(_scores(t)).select("model", "final_rank")


@query("topk_abs_contribution", f"""WITH c AS (SELECT l_partkey, sum(l_extendedprice * (l_discount - 0.05)) AS contribution FROM lineitem GROUP BY 1)
SELECT CAST(l_partkey AS VARCHAR) AS feature, {sql_r('contribution', 3)} AS contribution, CASE WHEN contribution >= 0 THEN 'increase' ELSE 'decrease' END AS direction FROM c ORDER BY abs(contribution) DESC LIMIT 10""")
def topk_abs_contribution(t):
    c = t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("feature")).agg(
        F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("contribution"))
    return scoring.top_contributions(c).withColumn("contribution", r("contribution", 3))


@query("topk_per_model", f"""WITH c AS (SELECT model, CAST(fold AS VARCHAR) AS feature, sum(actual - predicted) AS contribution FROM {{v_predictions}} GROUP BY ALL)
SELECT model, feature, {sql_r('contribution', 2)} AS contribution, CASE WHEN contribution >= 0 THEN 'increase' ELSE 'decrease' END AS direction,
 CAST(row_number() OVER (PARTITION BY model ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS place FROM c QUALIFY place <= 3""")
def topk_per_model(t):
    c = t.v_predictions.groupBy("model", F.col("fold").cast("string").alias("feature")).agg(
        F.sum(F.col("actual") - F.col("predicted")).alias("contribution"))
    return scoring.top_contributions(c, 3, ["model"]).withColumn("contribution", r("contribution", 2))
