"""Streams against their batch form, models end to end, and plan shapes."""

import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from aeroframe.operators import ml, scoring
from aeroframe.sources import writers
from aeroframe.streaming import jobs


def test_late_rows_and_repeats(spark, tmp_path):
    folder = str(tmp_path / "in")
    first = spark.sql("select * from values (1, 7, timestamp'2024-01-01 00:10:00', 5.0D), (2, 7, timestamp'2024-01-01 00:10:00', 6.0D), (3, 8, timestamp'2024-01-01 09:00:00', -1.0D) t(id, station_id, ts, pm25)")
    first.coalesce(1).write.parquet(folder)
    # a batch drops what was late for the batch before it: the late row comes third
    for values in ("(5, 8, timestamp'2024-01-01 12:00:00', 200.0D)", "(4, 9, timestamp'2024-01-01 00:20:00', 8.0D)"):
        time.sleep(1.1)                                       # files are read in the order of their seconds
        spark.sql(f"select * from values {values} t(id, station_id, ts, pm25)").coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, first.schema, files_per_batch=1)
    done = jobs.run_available(jobs.clean_stream(stream, "station_id", "ts", ["pm25"], {"pm25": (0.0, 100.0)}, "2 hours"), str(tmp_path / "out"))
    out = done.table.collect()
    stations = sorted(r.station_id for r in out)
    assert stations.count(7) == 1 and 8 in stations          # repeat dropped, negative dropped
    assert {r.pm25_outlier for r in out if r.station_id == 8} == {True}
    assert done.dropped == 1 and 9 not in stations           # the late row is counted


def test_timeline_has_every_hour_whatever_the_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    hours = [5, 0, 9, 2, 5, 1, 0, 9]
    for i, h in enumerate(hours):                            # one file each, out of order
        spark.sql(f"select timestamp'2024-01-01 {h:02d}:10:00' as detected_at, {i}.0D as frp").coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    done = jobs.run_available_keyed(jobs.fire_timeline_stream(stream), ["hour_ts"], str(tmp_path / "out"))
    got = {r.hour_ts.hour: (r.n_fires, r.total_frp) for r in done.table.collect()}
    assert got == {h: (hours.count(h), float(sum(i for i, x in enumerate(hours) if x == h))) for h in set(hours)}
    assert done.dropped == 0


def test_closed_hours_and_late_fires(spark, tmp_path):
    """Six batches: every fire is counted or listed as late, closed hours are those of Spark's appending aggregation."""
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    batches = [
        [("00:10", 1.0), ("01:10", 2.0), ("01:50", None)], [("03:30", 4.0), ("01:20", 8.0)], [("01:30", 16.0), ("06:00", 32.0)],
        [("03:40", 64.0), ("05:10", 128.0), (None, 9.0)], [("09:10", 256.0), ("06:59", 512.0)], [("06:30", 1024.0), ("08:30", 2048.0)]]
    stream, latest, want, late = None, "", {}, []
    for i, rows in enumerate(batches):
        made = [f"(timestamp'2024-01-01 {h}:00', {'null' if p is None else p})" if h else f"(null, {p})" for h, p in rows]
        spark.sql(f"select cast(detected_at as timestamp) as detected_at, cast(frp as double) as frp from values {', '.join(made)} t(detected_at, frp)"
                  ).coalesce(1).write.mode("append").parquet(folder)
        stream = stream or jobs.read_stream(spark, folder, spark.read.parquet(folder).schema)
        done = jobs.run_available_closing(stream, work, "1 hour")
        mark = f"{int(latest[:2]) - 1:02d}{latest[2:]}" if latest else ""
        for h, p in rows:
            if h and mark and f"{int(h[:2]) + 1:02d}:00" <= mark:
                late.append((i, h, p))
            elif h:
                n, total = want.get(int(h[:2]), (0, 0.0))
                want[int(h[:2])] = (n + (p is not None), total + (p or 0.0))
        latest = max([latest, *[h for h, _ in rows if h]])
    hours = done.hours.collect()
    assert {r.hour_ts.hour: (r.n_fires, r.total_frp) for r in hours} == want
    assert {(r.batch, r.detected_at.strftime("%H:%M"), r.frp) for r in done.late.collect()} == set(late) and len(late) >= 3
    assert {r.hour_ts.hour for r in hours if r.closed} == {h for h in want if h + 1 <= int(latest[:2]) - 1}

    # the appending aggregation over the same batches
    again, out = str(tmp_path / "again"), str(tmp_path / "out")
    for rows in batches:
        made = [f"(timestamp'2024-01-01 {h}:00', {'null' if p is None else p})" if h else f"(null, {p})" for h, p in rows]
        spark.sql(f"select cast(detected_at as timestamp) as detected_at, cast(frp as double) as frp from values {', '.join(made)} t(detected_at, frp)"
                  ).coalesce(1).write.mode("append").parquet(again)
        marked = jobs.read_stream(spark, again, stream.schema).withWatermark("detected_at", "1 hour")
        appended = jobs.run_available(jobs.fire_timeline_stream(marked), out)
    closed = {(r.hour_ts, r.n_fires, r.total_frp) for r in hours if r.closed}
    assert {(r.hour_ts, r.n_fires, r.total_frp) for r in appended.table.collect()} == closed


def test_batch_tried_again_counts_once(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    row = "select timestamp'2024-01-01 {}:10:00' as detected_at, {}D as frp"
    spark.sql(row.format("05", "1.0")).coalesce(1).write.parquet(folder)
    stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema)
    jobs.run_available_closing(stream, work, "1 hour")
    spark.sql(row.format("09", "2.0")).coalesce(1).write.mode("append").parquet(folder)
    jobs.run_available_closing(stream, work, "1 hour")
    for commit in (tmp_path / "work" / "state" / "commits").glob("*1*"):      # as if the run ended before the last commit
        commit.unlink()
    done = jobs.run_available_closing(stream, work, "1 hour")
    assert {(r.hour_ts.hour, r.n_fires, r.total_frp) for r in done.hours.collect()} == {(5, 1, 1.0), (9, 1, 2.0)}
    assert done.late.count() == 0


def test_timeline_of_an_empty_stream(spark, tmp_path):
    spark.range(0).select(F.current_timestamp().alias("detected_at"), F.lit(1.0).alias("frp")).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    done = jobs.run_available_closing(stream, str(tmp_path / "work"), "1 hour")
    assert done.hours.count() == 0 and done.late.count() == 0


def test_forest_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(i, float(i), float(i % 3) if i % 4 else None, "Winter" if i % 2 else "Monsoon", 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, temperature double, aod double, season string, aqi double")
    model = ml.train_forest(df, ["temperature", "aod"], "aqi", ["season"], n_trees=5, depth=4)
    scored = ml.score(model, df, ["temperature", "aod"])
    assert scored.columns == [*df.columns, "predicted"]
    table = ml.importances(model, spark)
    assert {r.feature for r in table.collect()} == {"temperature", "aod", "season_Monsoon", "season_Winter", "season_unknown"}
    top = ml.top_importances(table).collect()
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    writers.save_model(model, str(tmp_path), scoring.regression_metrics(scored, actual="aqi"), table)
    again = ml.score(PipelineModel.load(f"{tmp_path}/model"), df, ["temperature", "aod"])
    assert again.where("predicted > 0").count() > 0
    unknown = df.limit(1).withColumn("season", F.lit("never seen"))
    assert ml.score(model, unknown, ["temperature", "aod"]).count() == 1


def test_failing_model_is_reported(spark):
    class Broken:
        def fit(self, _):
            raise ValueError("no")

    class Lost:
        def fit(self, _):
            raise RuntimeError("executor lost")

    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "x double, y double")
    rows = ml.compare_models(df, df, ["x"], "y", {"broken": Broken(), ml.LINEAR: ml.regressors()[ml.LINEAR]}).collect()
    got = {r.model: r for r in rows}
    assert got["broken"].rmse is None and got["broken"].error == "no" and got[ml.LINEAR].r2 == pytest.approx(1.0)
    with pytest.raises(RuntimeError):
        ml.compare_models(df, df, ["x"], "y", {"lost": Lost()})


def test_missing_category_is_the_most_frequent(spark):
    rows = [(1.0, "it's"), (2.0, "it's"), (3.0, "b"), (4.0, None)]
    df = spark.createDataFrame(rows, "x double, season string")
    model = ml.fit_preprocessing(df, ["x"], ["season"])
    assert ml.feature_names(model) == ["x", "season_b", "season_it's", "season_unknown"]
    vectors = [r.features.toArray()[1:].tolist() for r in model.transform(ml.as_doubles(df, ["x"])).orderBy("x").collect()]
    assert vectors == [[0, 1, 0], [0, 1, 0], [1, 0, 0], [0, 1, 0]]


def test_selection_takes_a_fitted_importance_table(spark):
    from aeroframe.plans import flows

    rows = [(float(i), float((i * 7) % 11), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "pm25 double, pm10 double, aqi double")
    model = ml.train_forest(df, ["pm25", "pm10"], "aqi", n_trees=5, depth=4)
    got = {r.feature: r.importance for r in flows.feature_selection(df, ["pm25", "pm10"], "aqi", ml.importances(model, spark)).collect()}
    assert got["pm25"] > got["pm10"] and sum(got.values()) == pytest.approx(1.0)


def test_contributions_of_every_row(spark):
    df = spark.range(40).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    table = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "feature string, importance double")
    out = ml.local_contributions(df, table, ["a", "b"], "id").collect()
    assert len(out) == 80 and {(r.feature, r.contribution) for r in out} == {("a", 0.75), ("b", 0.25)}


def test_folds_and_grids(spark):
    folded = ml.with_folds(spark.range(1000), "id", 5)
    assert folded.groupBy("fold").count().count() == 5
    assert len(ml.tuning_grids("compact")[ml.FOREST][1]) == 6 and len(ml.tuning_grids()[ml.BOOSTED][1]) == 162
    with pytest.raises(ValueError):
        ml.tuning_grids("huge")


ROW_SCALE = ["station_day_index", "aqi_overall", "clean_flow", "asof_nearest_time", "nearest_grid_cell", "attach_grid_features",
             "reject_invalid_matches", "collocate", "fill_forward", "fill_interpolate", "fill_station_median", "chronological_split",
             "iqr_outlier_flags", "merge_products", "dedup_station_time"]


@pytest.mark.parametrize("name", ROW_SCALE)
def test_plan_shape(spark, folder, name):
    plan = contract.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    assert not re.search(r"\bExecutedCommand\b", plan)


def test_scan_reads_only_what_is_needed(spark, folder):
    plan = contract.queries()["station_day_index"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<(event_id[^>]*)>", plan).group(1)
    assert "props" not in schema
    plan = contract.queries()["dedup_station_time"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2           # one before the shuffle, one after


def test_filter_reaches_the_scan(spark, folder):
    plan = contract.queries()["fire_query"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,10.0)" in plan
