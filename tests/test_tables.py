"""Columns, sources, sinks, cleaning, checks and registry rules on small frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F, types as T

from aeroframe import values as V
from aeroframe.operators import clean, columns as cols, dedup, filters, grids, profile, quality, scoring, stations as reg
from aeroframe.functions import masks, time as tm, weather
from aeroframe.plans import flows
from aeroframe.sources import readers, writers


def test_group_registry():
    assert cols.groups() == ["GEOGRAPHY", "METADATA", "METEOROLOGY", "SATELLITE", "TARGET", "TEMPORAL"]
    assert cols.features_in_group("satellite") == V.SATELLITE_FEATURES
    assert cols.group_of("aod") == "SATELLITE" and cols.group_of("nothing") is None
    assert len(V.FEATURES) == 33 and len(V.FEATURE_DICTIONARY) == 22 and len(V.LINEAGE) == 25
    assert len(V.CITY_COORDINATES) == 52 and len(V.PRODUCTS) == 8


def test_select_by_group(spark):
    df = spark.createDataFrame([(0.1, 280.0, True, "s", 5.0)], "aod double, temperature double, weekend_flag boolean, station_id string, pm25 double")
    assert cols.select_by_group(df, ["meteorology", "temporal"]).columns == ["temperature", "weekend_flag", "station_id", "pm25"]


def test_renames_reject_clashes(spark):
    df = spark.createDataFrame([(1, 2)], "ozone int, O3 int")
    with pytest.raises(ValueError):
        cols.rename_pollutant_columns(df)


def test_target_fallback(spark):
    assert cols.target_column(spark.createDataFrame([(1.0, "a", 2.0)], "a double, b string, c double")) == "c"
    assert cols.target_column(spark.createDataFrame([(1.0, 2.0)], "pm25 double, c double")) == "pm25"
    with pytest.raises(ValueError):
        cols.target_column(spark.createDataFrame([("x",)], "b string"))


def test_csv_with_bad_token_and_offset(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,value\nA,1.5\nB,oops\nC,\n")
    schema = T.StructType([T.StructField("station", T.StringType()), T.StructField("value", T.DoubleType())])
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), schema, ["value"]).orderBy("station").collect()
    assert [r.value for r in rows] == [1.5, None, None]


def test_latest_snapshot_and_none(spark, tmp_path):
    import os
    schema = T.StructType([T.StructField("v", T.LongType())])
    for i, name in enumerate(["raw_1.csv", "raw_2.csv", "raw_0.csv"]):
        (tmp_path / name).write_text(f"v\n{i}\n")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert readers.read_latest(spark, str(tmp_path), "raw_*.csv", schema).collect()[0].v == 2
    assert readers.read_latest(spark, str(tmp_path), "none_*.csv", schema) is None


def test_pages_and_broken_page(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"records": [{"s": "a"}, {"s": "b"}], "total": 2}))
    (tmp_path / "p2.json").write_text(json.dumps({"records": "oops", "total": 2}))
    (tmp_path / "p3.json").write_text(json.dumps({"records": [{"s": "c"}], "total": 3}))
    got = readers.read_pages(spark, str(tmp_path), T.StructType([T.StructField("s", T.StringType())]))
    assert sorted(r.s for r in got.records.collect()) == ["a", "b", "c"]
    assert sorted((r.state, r.n_records) for r in got.pages.collect()) == [("complete", 2), ("incomplete", 1), ("unreadable", 0)]


def test_bad_text_in_a_fixed_column_is_null_and_counted(spark):
    schema = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("city", T.StringType())])
    df = spark.createDataFrame([("1.5", "a"), ("n/a", "b"), (None, "c")], "latitude string, city string")
    assert [r.latitude for r in cols.ensure_columns(df, schema).orderBy("city").collect()] == [1.5, None, None]
    assert cols.cast_failures(df, schema).first().asDict() == {"latitude": 1, "city": 0}


def test_products_with_several_pixels_on_one_key(spark):
    a = spark.sql("select * from values (1, 10.01D, 20.02D, 4.0D), (1, 9.98D, 19.99D, 8.0D), (1, 10.31D, 20.0D, 1.0D) t(timestamp, latitude, longitude, aod)")
    b = spark.sql("select * from values (1, 10.02D, 20.01D, 3.0D), (1, 10.0D, 20.0D, 5.0D) t(timestamp, latitude, longitude, hcho)")
    got = {(r.latitude, r.longitude): (r.aod, r.hcho) for r in grids.merge_products([a, b], ["aod", "hcho"]).collect()}
    assert got == {(10.0, 20.0): (6.0, 4.0), (10.3, 20.0): (1.0, None)}


def test_snapshot_with_folders_inside(spark, tmp_path):
    schema = T.StructType([T.StructField("v", T.LongType())])
    spark.range(100).toDF("v").write.option("header", True).csv(str(tmp_path / "raw_0900"))
    rows = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") % 4).alias("p"))
    rows.write.partitionBy("p").option("header", True).csv(str(tmp_path / "raw_1000"))
    assert readers.newest_snapshot(spark, str(tmp_path), "raw_*") == f"{tmp_path}/raw_1000"
    assert readers.read_latest(spark, str(tmp_path), "raw_*", schema).count() == 1000


def test_cube_order(spark):
    df = spark.createDataFrame([([1, 2], [10.0, 20.0], [5.0, 6.0, 7.0], [float(i) for i in range(12)])],
                               "times array<int>, lats array<double>, lons array<double>, v array<double>")
    rows = {(r.timestamp, r.latitude, r.longitude): r.x for r in readers.flatten_grid(df, {"v": "x"}).collect()}
    assert len(rows) == 12 and rows[(1, 20.0, 6.0)] == 4.0 and rows[(2, 10.0, 7.0)] == 8.0


def test_manifest_appends(spark, tmp_path):
    path = str(tmp_path / "m")
    for n in (1, 2):
        writers.append_manifest(spark, path, "d", "u", n, "SUCCESS")
    assert sorted(r.n_rows for r in spark.read.parquet(path).collect()) == [1, 2]
    assert writers.write_table(spark.range(7), str(tmp_path / "t")) == 7


def test_times(spark):
    texts = ["2024-01-02T03:04:05+05:30", "2024-01-02 03:04:05", "01-02-2024 03:04:05", "", "soon", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.250000"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    rows = [(r.a, r.b) for r in df.select("i", tm.iso_text(F.col("x")).alias("a"), tm.instant(F.col("x")).alias("b")).orderBy("i").collect()]
    assert [a for a, _ in rows] == ["2024-01-02T03:04:05+05:30", "2024-01-02T03:04:05", "2024-01-02T03:04:05", None, None,
                                    "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.250000"]
    assert rows[0][1] == dt.datetime(2024, 1, 1, 21, 34, 5)
    strict = spark.createDataFrame([("2024-01-02", "03:04:05"), ("2024-1-2", "03:04:05"), (" 2024-01-02 ", "03:04:05 "), ("2024-02-30", "00:00:00"), (None, "00:00:00")], "d string, t string")
    assert [r.x is not None for r in strict.select(tm.parse_date_time(F.col("d"), F.col("t")).alias("x")).collect()] == [True, False, True, False, False]


def test_wind(spark):
    row = spark.range(1).select(weather.wind_speed(F.lit(3.0), F.lit(4.0)).alias("s"), weather.wind_direction(F.lit(1.0), F.lit(0.0)).alias("d"),
                                weather.wind_direction(F.lit(1.0), F.lit(0.0), "from").alias("f"), weather.wind_speed(F.lit(None), F.lit(4.0)).alias("n")).collect()[0]
    assert (row.s, row.d, row.f, row.n) == (5.0, 90.0, 270.0, None)


def test_unknown_confidence_level():
    with pytest.raises(ValueError):
        masks.fire_confidence_ok(None, "certain")


def test_first_of_hot_key(spark):
    df = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    marked = dedup.mark_first(df, ["k"], "id", "first", where=F.col("id") >= 10)
    assert [r.id for r in marked.where("first and k = 'hot'").collect()] == [10]
    assert marked.count() == 3000
    assert dedup.first_per_key(df, ["k"], ["id"]).where("k = 'hot'").collect()[0].id == 1


def test_null_keys_compare_equal(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 1.0), (3, "a", 1.0)], "ordinal long, k string, v double")
    assert sorted(r.ordinal for r in dedup.distinct_rows(df, "ordinal").collect()) == [1, 3]
    assert sorted(r.ordinal for r in dedup.first_per_key(df, ["k"], ["ordinal"]).collect()) == [1, 3]


def test_fences_without_spread(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, 1.0), (5.0, 2.0), (500.0, 3.0), (5.0, 900.0)], "a double, b double")
    rows = clean.flag_outliers(df, ["a", "b"]).collect()
    assert not any(r.a_outlier for r in rows)            # zero spread flags nothing
    assert [r.b_outlier for r in rows] == [False, False, False, False, True]


def test_duplicate_can_lose_both_rows(spark):
    rows = [(1, "s", "2024-01-01", "00:00:00", "20", "77", 60.0, 1.0), (2, "s", "2024-01-01", "00:00:00", "20", "77", 10.0, 1.0)]
    df = spark.createDataFrame(rows, "ordinal long, station_id string, date string, time string, latitude string, longitude string, satellite_match_distance_km double, era5_match_distance_km double")
    got = {r.ordinal: r.reason_code for r in quality.reject_invalid(df).collect()}
    assert got == {1: "satellite_distance", 2: "duplicate_station_time"}
    absent = quality.reject_invalid(df.drop("time")).collect()
    assert {r.reason for r in absent} == {"Required column 'time' absent from dataset"}


def test_upper_median_window(spark):
    df = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 05:00:00'), (3, timestamp'2024-01-01 06:00:00'), (4, timestamp'2024-01-09 00:00:00'), (5, null) t(id, ts)")
    assert sorted(r.id for r in quality.within_time(df, "ts", 1.0).where("accepted").collect()) == [2, 3]


def test_range_check_cases(spark):
    df = spark.createDataFrame([("280.0", 50.0, True), ("100.0", 150.0, False), (None, 20.0, None)], "temperature string, relative_humidity double, weekend_flag boolean")
    got = {r.feature: r for r in quality.feature_range_check(df).where("present").collect()}
    assert (got["temperature"].out_of_range, got["relative_humidity"].out_of_range, got["temperature"].status) == (1, 1, "PASSED")
    bad = spark.createDataFrame([("hot",)], "temperature string")
    assert quality.feature_range_check(bad).where("feature = 'temperature'").collect()[0].status == "FAILED"


def test_variance_and_collinearity(spark):
    df = spark.createDataFrame([(1.0, 7.0, 10.0), (2.0, 7.0, 20.0), (3.0, 7.0, 30.0), (4.0, 7.0, 40.0)], "x double, c double, pm25 double")
    assert [r.column_name for r in profile.variances(df, ["x", "c"]).where("dropped").collect()] == ["c"]
    rows = [(float(i), 2.0 * i + 0.001, float((i * 7) % 5), 1.5 * i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "a double, b double, c double, target double")
    assert profile.collect_collinear_drops(df, ["a", "b", "c"], "target") in (["a"], ["b"])
    assert profile.collect_collinear_drops(df, ["a", "b", "c"]) == ["b"]


def test_metrics_case(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0), (30.0, 32.0)], "actual double, predicted double")
    row = scoring.regression_metrics(df).collect()[0]
    assert row.mae == 2.0 and row.mbe == pytest.approx(2 / 3)
    single = scoring.residual_summary(scoring.with_residuals(df.limit(1))).collect()[0]
    assert single.std_residual == 0.0


def test_scores_skip_infinite_and_unknown(spark):
    comparison = spark.createDataFrame([("a", 10.0), ("b", float("inf"))], "model string, rmse double")
    folds = spark.createDataFrame([("a", 20.0), ("a", float("inf")), ("only_cv", 1.0)], "model string, rmse double")
    got = {r.model: r for r in scoring.score_candidates(comparison, folds, None).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].score == pytest.approx((10 * 0.2 + 20 * 0.4) / 0.6) and got["a"].final_rank == 1
    assert got["b"].score is None and got["b"].final_rank == 2


def test_consolidated_registry(spark):
    a = spark.createDataFrame([(1, "X", "Delhi", "DL", "old"), (2, "X", "Delhi", "DL", "new"), (3, "Y", "Nowhere", "NN", "t")],
                              "ordinal long, station string, city string, state string, last_update string")
    b = spark.createDataFrame([(1, "X", "c", 1.0, 2.0, "u1"), (2, "X", "c", None, 9.0, "u2"), (3, "Z", "c", 5.0, 6.0, "u3"), (4, "Z", "c", 5.0, 6.0, "u4")],
                              "ordinal long, station string, city string, latitude double, longitude double, utc_time string")
    got = {r.station_name: r for r in reg.consolidate(a, b).collect()}
    assert (got["X"].station_id, got["X"].latitude, got["X"].longitude, got["X"].source, got["X"].last_updated) == ("STN_001", 1.0, 2.0, "CPCB, OpenAQ", "new")
    assert (got["Y"].latitude, got["Y"].source) == (None, "CPCB")
    assert (got["Z"].station_id, got["Z"].state, got["Z"].source, got["Z"].last_updated) == ("STN_003", "", "OpenAQ", "u3")


def test_small_grid(spark):
    box = (70.0, 20.0, 70.2, 20.2)
    step, _, n_lat, n_lon = grids.grid_shape(box)
    assert 0.044 < step < 0.046
    rows = grids.analysis_grid(spark, box).collect()
    assert len(rows) == n_lat * n_lon and rows[0].grid_id == "GRID_000000"
    assert all(70 <= r.longitude <= 70.2 and 20 <= r.latitude <= 20.2 for r in rows)
    assert all(len(r.corners) == 5 and r.corners[0] == r.corners[4] for r in rows)


def test_target_reconstruction(spark):
    df = spark.createDataFrame([(15.0, 25.0), (45.0, 75.0)], "pm25 double, pm10 double")
    assert sorted(r.aqi for r in flows.reconstruct_target(df).collect()) == [25.0, 75.0]
    kept = spark.createDataFrame([(15.0, 7.0), (45.0, None)], "pm25 double, aqi double")
    assert [r.aqi for r in flows.reconstruct_target(kept).collect()] == [7.0, None]
    with pytest.raises(ValueError):
        flows.reconstruct_target(spark.createDataFrame([("x",)], "s string"))


def test_analysis_needs_a_target(spark):
    df = spark.createDataFrame([(1, "s", "2024-01-01", "00:00:00", 20.0, 77.0, None)],
                               "ordinal long, station_id string, date string, time string, latitude double, longitude double, aqi double")
    with pytest.raises(ValueError):
        flows.analysis_table(df)
    with pytest.raises(ValueError):
        flows.analysis_table(df.drop("aqi"))


def test_integration_without_grids(spark):
    obs = spark.sql("select 1L ordinal, 'A' station_name, timestamp'2024-01-06 10:00:00' ts, 12.5D pm25")
    stations = spark.createDataFrame([("S1", "A", "c", "st", 20.0, 77.0)], "station_id string, station_name string, city string, state string, latitude double, longitude double")
    row = flows.integrate(obs, stations, None, None).collect()[0]
    assert (row.station_id, row.placeholder_used, row.season, row.weekend_flag, row.day_of_week, row.aod, row.satellite_match_distance_km) == ("S1", True, "Winter", True, 5, None, None)
    with pytest.raises(ValueError):
        flows.attach_grid(obs, None, [], "x", "weekly")


def test_negative_rows(spark):
    df = spark.createDataFrame([(1, -1.0, None), (2, None, None), (3, 1.0, 2.0)], "i int, pm25 double, pm10 double")
    assert sorted(r.i for r in filters.drop_negative_rows(df).collect()) == [2, 3]


def test_first_existing_candidate(spark, tmp_path):
    (tmp_path / "cpcb_station_list.csv").write_text("id\n1\n")
    assert readers.first_existing(spark, str(tmp_path), V.OFFICIAL_LIST_FILES).endswith("/cpcb_station_list.csv")
    assert readers.first_existing(spark, str(tmp_path), V.SATELLITE_GRID_FILES) is None


def test_products():
    assert grids.product("tropomi_co")["bands"] == ["CO_column_number_density"]
    assert grids.product("nothing") is None


def test_single_values(spark):
    df = spark.createDataFrame([("280", True), ("hot", None), ("10", False), (None, True)], "temperature string, weekend_flag boolean")
    got = [(r.a, r.b) for r in df.select(quality.value_ok("temperature").alias("a"), quality.value_ok("weekend_flag").alias("b")).collect()]
    assert got == [(True, True), (False, True), (False, True), (True, True)]


def test_cleaning_flow_counts_add_up(spark):
    rows = [(1, "s", "2024-01-01 00:00:00", 5.0), (2, "s", "2024-01-01 00:00:00", 5.0), (3, "s", "2024-01-01 00:00:00", 9.0),
            (4, "s", "2024-01-02 00:00:00", -1.0), (5, "t", "nonsense", 2.0)]
    df = spark.createDataFrame(rows, "ordinal long, station string, last_update string, pm2_5 double")
    out = {r.ordinal: r for r in flows.clean_source(df, "CPCB").collect()}
    assert set(out) == {1, 5} and out[1].last_update == "2024-01-01T00:00:00" and out[5].last_update is None
    assert out[1].pm25_unit == "ug/m3" and out[1].pm25_outlier is False
    m = clean.cleaning_metrics(cols.rename_pollutant_columns(df), "station", "last_update", ["pm25"], "ordinal").collect()[0]
    assert (m.rows_before, m.duplicates_removed, m.duplicate_timestamps_removed, m.negative_pollutant_values, m.rows_after) == (5, 1, 1, 1, 2)
    with pytest.raises(ValueError):
        flows.clean_source(df, "elsewhere")
