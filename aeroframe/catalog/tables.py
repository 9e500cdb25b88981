"""Sources, sinks, streams and models."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F, types as T

from aeroframe.catalog.registry import query, r, sql_r
from aeroframe.operators import ensembles, filters, ml, scoring, split
from aeroframe.operators.sizes import attach_row
from aeroframe.plans import flows
from aeroframe.session import cut_lineage, shared_dir
from aeroframe.sources import readers, writers
from aeroframe.streaming import jobs


def _folder(t, name: str) -> str:
    """A new folder per call in the shared folder, so that nothing is overwritten."""
    return f"{shared_dir(t.spark)}/aeroframe/{name}-{uuid.uuid4().hex}"


_RAW = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("station", T.StringType()),
                     *[T.StructField(c, T.DoubleType()) for c in ("pm25", "pm10", "no2")]])


# -- sources and sinks -----------------------------------------------------------------------------


@query("src_csv", "SELECT ordinal, station, pm25, pm10, no2 FROM {v_raw}")
def src_csv(t):
    path = _folder(t, "csv")
    writers.write_csv(t.v_raw.select(_RAW.names), path)
    return readers.read_csv(t.spark, path, _RAW, ["pm25", "pm10", "no2"])


@query("src_latest_snapshot", "SELECT ordinal, station, pm25, pm10, no2 FROM {v_raw}")
def src_latest_snapshot(t):
    folder = _folder(t, "snapshots")
    writers.write_csv(t.v_raw.select("ordinal", "station", F.lit(0.0).alias("pm25"), "pm10", "no2"), f"{folder}/raw_0900")
    # a snapshot with folders inside it
    parts = t.v_raw.select(*_RAW.names, (F.col("ordinal") % 4).alias("part"))
    parts.write.partitionBy("part").option("header", True).csv(f"{folder}/raw_1000")
    return readers.read_latest(t.spark, folder, "raw_*", _RAW, ["pm25", "pm10", "no2"])


_RECORD = T.StructType([T.StructField("station", T.StringType()), T.StructField("pollutant_id", T.StringType()),
                        T.StructField("pollutant_avg", T.DoubleType()), T.StructField("ordinal", T.LongType())])


@query("src_json_pages", """SELECT ordinal, CAST(station_id AS VARCHAR) AS station, pollutant AS pollutant_id, value AS pollutant_avg FROM {v_obs_long}
 WHERE floor(ordinal / 500) % 7 <> 3""")
def src_json_pages(t):
    return readers.read_pages(t.spark, _pages(t), _RECORD, one_per_file=False).records.drop("page")


@query("src_json_page_check", """WITH p AS (SELECT floor(ordinal / 500) AS page, count(*) AS n FROM {v_obs_long} GROUP BY 1)
SELECT CASE WHEN page % 7 = 3 THEN 'unreadable' WHEN page % 5 = 2 THEN 'incomplete' ELSE 'complete' END AS state, count(*) AS n_pages,
 CAST(sum(CASE WHEN page % 7 <> 3 THEN n ELSE 0 END) AS BIGINT) AS n_records FROM p GROUP BY 1""")
def src_json_page_check(t):
    checked = readers.read_pages(t.spark, _pages(t), _RECORD, one_per_file=False).pages
    return checked.groupBy("state").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_records").alias("n_records"))


def _pages(t) -> str:
    """Pages of at most 500 records; some announce more than they hold, some are broken."""
    path = _folder(t, "pages")
    record = F.struct(F.col("station_id").cast("string").alias("station"), F.col("pollutant").alias("pollutant_id"),
                      F.col("value").alias("pollutant_avg"), "ordinal")
    pages = t.v_obs_long.groupBy(F.floor(F.col("ordinal") / 500).alias("page")).agg(
        F.collect_list(record).alias("records"), F.count(F.lit(1)).alias("n"))
    total = F.col("n") + F.when(F.col("page") % 5 == 2, 1).otherwise(0)
    text = F.to_json(F.struct("records", total.alias("total")))
    broken = F.lit('{"records": "oops", "total": 500}')
    pages.select(F.when(F.col("page") % 7 == 3, broken).otherwise(text).alias("value")).write.text(path)
    return path


@query("src_json_flatten", """SELECT event_id AS location_id, 'Place ' || user_id AS location, event_type AS parameter, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS latitude, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(70 AS DOUBLE) END AS longitude,
 CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_time FROM events WHERE user_id % 13 <> 0""")
def src_json_flatten(t):
    place = F.when(F.col("user_id") % 13 != 0, F.concat(F.lit("Place "), F.col("user_id").cast("string")))
    point = F.when(F.col("event_id") % 4 != 0, F.struct(F.col("user_id").cast("double").alias("latitude"), F.lit(70.0).alias("longitude")))
    text = F.to_json(F.struct(
        F.col("event_id").alias("locationId"), place.alias("location"), F.lit("IN").alias("country"), F.col("event_type").alias("parameter"),
        F.get_json_object("props", "$.k").cast("double").alias("value"), point.alias("coordinates"),
        F.struct(F.col("ts").cast("date").cast("string").alias("utc")).alias("date")))
    nested = t.events.select(F.from_json(text, readers.MEASUREMENT).alias("m")).select("m.*")
    return readers.flatten_measurements(nested).select("location_id", "location", "parameter", "value", "latitude", "longitude", "utc_time")


@query("src_grid_flatten", """WITH c AS (SELECT vec_id, embedding, len(embedding) // 4 AS n_lon FROM embeddings),
x AS (SELECT vec_id, n_lon, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM c)
SELECT vec_id AS "timestamp", CAST(i // n_lon AS DOUBLE) AS latitude, CAST(i % n_lon AS DOUBLE) AS longitude, CAST(v AS DOUBLE) AS aod FROM x""")
def src_grid_flatten(t):
    n_lon = F.floor(F.size("embedding") / 4).cast("int")
    cubes = t.embeddings.select(
        F.array("vec_id").alias("times"), F.array(*[F.lit(float(i)) for i in range(4)]).alias("lats"),
        F.transform(F.sequence(F.lit(0), n_lon - 1), lambda i: i.cast("double")).alias("lons"), F.col("embedding").alias("values"))
    out = readers.flatten_grid(cubes, {"values": "aod"})
    return readers.nan_to_null(out.withColumn("aod", F.col("aod").cast("double")))


@query("sink_manifest_append", "SELECT 'events' AS dataset, 'events.parquet' AS url, count(*) AS n_rows, 'SUCCESS' AS status FROM events UNION ALL SELECT 'orders', 'orders.parquet', count(*), 'SUCCESS' FROM orders")
def sink_manifest_append(t):
    folder = _folder(t, "manifest")
    for name in ("events", "orders"):
        n = writers.write_table(getattr(t, name), f"{folder}/{name}")
        writers.append_manifest(t.spark, f"{folder}/log", name, f"{name}.parquet", n, "SUCCESS")
    return t.spark.read.schema(writers.MANIFEST_SCHEMA).parquet(f"{folder}/log").drop("written_at")


@query("sink_splits", """WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM o, n""")
def sink_splits(t):
    path = _folder(t, "splits")
    writers.write_splits(split.chronological_split(t.orders, "o_orderdate", "o_orderkey"), path)
    return t.spark.read.parquet(path).select("o_orderkey", "o_totalprice", "split")


# -- streams -----------------------------------------------------------------------------------------


@query("stream_fire_timeline", f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_ts, count(value) AS n_fires, {sql_r('sum(value)', 3)} AS total_frp,
 CAST(0 AS BIGINT) AS n_dropped FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def stream_fire_timeline(t):
    stream = jobs.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    fires = stream.select(F.col("ts").cast("timestamp").alias("detected_at"), F.col("value").alias("frp"))
    done = jobs.run_available_keyed(jobs.fire_timeline_stream(fires), ["hour_ts"], _folder(t, "fires"))
    return done.table.withColumns({"total_frp": r("total_frp", 3), "n_dropped": F.lit(done.dropped).cast("long")})


# events arrive in six runs: five stretches of the month, every fiftieth event one run late
_ARRIVAL = "CAST(least(4, floor((day(ts) - 1) / 6)) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS INT)"


@query("stream_fire_timeline_closed", f"""WITH f AS (SELECT ts, value, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_ts, {_ARRIVAL} AS run FROM events WHERE ts IS NOT NULL),
latest AS (SELECT run, max(ts) AS latest FROM f GROUP BY run),
marks AS (SELECT r.run, max(l.latest) - INTERVAL 2 HOUR AS mark FROM (SELECT DISTINCT run FROM f) r LEFT JOIN latest l ON l.run < r.run GROUP BY r.run),
j AS (SELECT f.*, coalesce(hour_ts + INTERVAL 1 HOUR <= mark, FALSE) AS late FROM f JOIN marks USING (run))
SELECT hour_ts, CAST(count(value) FILTER (NOT late) AS BIGINT) AS n_fires, {sql_r('coalesce(sum(value) FILTER (NOT late), 0)', 3)} AS total_frp,
 CAST(count(*) FILTER (late) AS BIGINT) AS n_late, hour_ts + INTERVAL 1 HOUR <= (SELECT max(latest) FROM latest) - INTERVAL 2 HOUR AS closed
FROM j GROUP BY hour_ts""")
def stream_fire_timeline_closed(t):
    arrived = t.events.where(F.col("ts").isNotNull()).withColumn("run", F.expr(_ARRIVAL))
    shaped = arrived.select(F.col("ts").cast("timestamp").alias("detected_at"), F.col("value").alias("frp"), "run")
    inbox, work = _folder(t, "fires-in"), _folder(t, "fires-closed")
    for run in range(6):
        shaped.where(F.col("run") == run).write.mode("append").parquet(inbox)
        done = jobs.run_available_closing(jobs.read_stream(t.spark, inbox, shaped.schema), work, "2 hours")
    late = done.late.groupBy(F.date_trunc("hour", "detected_at").alias("hour_ts")).agg(F.count(F.lit(1)).alias("n_late"))
    # an hour that has late fires only is closed
    return done.hours.join(late, "hour_ts", "full").select(
        "hour_ts", F.coalesce("n_fires", F.lit(0)).cast("long").alias("n_fires"), r(F.coalesce("total_frp", F.lit(0.0)), 3).alias("total_frp"),
        F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"), F.coalesce("closed", F.lit(True)).alias("closed"))


@query("stream_clean", """WITH kept AS (SELECT event_id, user_id AS station_id, CAST(ts AS TIMESTAMP) AS ts, value AS pm25 FROM events WHERE event_id % 97 <> 0 OR value = 0),
q AS (SELECT quantile_cont(pm25, 0.25) AS a, quantile_cont(pm25, 0.75) AS b FROM kept)
SELECT event_id, station_id, ts, pm25, pm25 < a - 1.5 * (b - a) OR pm25 > b + 1.5 * (b - a) AS pm25_outlier, 'ug/m3' AS pm25_unit, CAST(0 AS BIGINT) AS n_dropped FROM kept, q""")
def stream_clean(t):
    stream = jobs.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    shaped = lambda df: df.select(
        "event_id", F.col("user_id").alias("station_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 97 == 0, -F.col("value")).otherwise(F.col("value")).alias("pm25"))
    readings = shaped(stream)
    # fences come from the finished table
    fences = jobs.collect_fences(filters.drop_negative_rows(shaped(t.events), ["pm25"]), ["pm25"])
    # every row arrives twice: the second copy falls to the keyed de-duplication
    twice = readings.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    done = jobs.run_available(jobs.clean_stream(twice, "station_id", "ts", ["pm25"], fences, "2 hours"), _folder(t, "clean"))
    return done.table.withColumn("n_dropped", F.lit(done.dropped).cast("long"))


# -- models --------------------------------------------------------------------------------------------
# Fitted trees differ from engine to engine, so these queries show what must hold of any fit, next to
# figures that both engines compute: row counts, split membership, feature values.

_NUM = ["pm25", "pm10", "no2", "so2", "temperature", "relative_humidity"]
_FITTED: dict[tuple, object] = {}

_HALVES = """ranked AS (SELECT *, row_number() OVER (ORDER BY ts, ordinal) AS rn, count(*) OVER () AS n FROM {v_training}),
train AS (SELECT * FROM ranked WHERE rn <= floor(n * CAST(0.7 AS DOUBLE))),
test AS (SELECT * FROM ranked WHERE rn > floor(n * CAST(0.7 AS DOUBLE)))"""


def _once(t, name: str, make):
    """One fit per session and input, shared by the queries that show different sides of it."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _halves(t):
    labelled = split.holdout_split(t.v_training, "ts", "ordinal")
    return labelled.where("split = 'train'").drop("split"), labelled.where("split = 'test'").drop("split")


def _flow(t):
    return _once(t, "flow", lambda: flows.train_and_score(t.v_training, _NUM, "aqi", "ts", "ordinal"))


def _forest(t):
    return _once(t, "forest", lambda: ml.train_forest(_halves(t)[0], _NUM, "aqi", ["season"]))


_SCALED = ("pm25", "pm10", "no2")


@query("preprocess_features", "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _SCALED) + " FROM {v_training}) "
       + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sql_r(f'avg({c})')} AS mean, {sql_r(f'sqrt(sum(pow(coalesce({c}, m_{c}) - m_{c}, 2)) / (count(*) - 1))')} AS std FROM {{v_training}}, m"
    for c in _SCALED))
def preprocess_features(t):
    model = ml.fit_preprocessing(t.v_training, list(_SCALED), ["season"])
    out = ml.scaling_table(model, list(_SCALED), t.spark)
    return out.withColumns({"mean": r("mean"), "std": r("std")})


@query("preprocess_categories", """WITH top AS (SELECT season FROM {v_training} WHERE season IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, season LIMIT 1)
SELECT coalesce(t.season, top.season) AS season, count(*) AS n FROM {v_training} t, top GROUP BY 1""")
def preprocess_categories(t):
    """Rows per category as the encoded vectors hold them: missing ones count for the most frequent."""
    model = ml.fit_preprocessing(t.v_training, [], ["season"])
    encoded = model.transform(t.v_training).select(vector_to_array("season_hot").alias("v"))
    names = F.array(*[F.lit(n.removeprefix("season_")) for n in ml.feature_names(model)])
    slot = F.array_position("v", 1.0)
    return encoded.select(F.element_at(names, slot.cast("int")).alias("season")).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("train_random_forest", f"WITH {_HALVES} SELECT count(*) AS n, TRUE AS beats_mean, TRUE AS fits FROM test")
def train_random_forest(t):
    _, metrics, scored = _flow(t)
    spread = scored.agg(F.stddev_pop("aqi")).scalar()
    return metrics.select("n", (F.col("rmse") < spread).alias("beats_mean"), (F.col("r2") > 0.9).alias("fits"))


@query("batch_score", f"WITH {_HALVES} SELECT ordinal, {sql_r('aqi')} AS aqi, TRUE AS inside_labels FROM test")
def batch_score(t):
    _, _, scored = _flow(t)
    seen = _halves(t)[0].agg(F.struct(F.min("aqi").alias("lo"), F.max("aqi").alias("hi")).alias("s"))
    placed = attach_row(scored, seen.select("s.*"), "_seen")
    return placed.select("ordinal", r("aqi").alias("aqi"), F.col("predicted").between(F.col("_seen.lo"), F.col("_seen.hi")).alias("inside_labels"))


@query("sink_model", f"WITH {_HALVES} SELECT ordinal, TRUE AS same_prediction FROM test")
def sink_model(t):
    """Every prediction of the model that was saved and loaded again."""
    from pyspark.ml import PipelineModel

    path, model, (_, test) = _folder(t, "model"), _forest(t), _halves(t)
    # metrics and comparison read the same predictions, which cost more than all else here
    scored = cut_lineage(ml.score(model, test, _NUM).select("ordinal", "aqi", "predicted"))
    writers.save_model(model, path, scoring.regression_metrics(scored, actual="aqi"), ml.importances(model, t.spark))
    again = ml.score(PipelineModel.load(f"{path}/model"), test, _NUM).select("ordinal", F.col("predicted").alias("loaded"))
    return scored.join(again, "ordinal").select("ordinal", (F.col("predicted") == F.col("loaded")).alias("same_prediction"))


_SLOTS = "(SELECT DISTINCT 'season_' || season AS feature FROM {v_training} WHERE season IS NOT NULL UNION ALL SELECT unnest([" + ", ".join(
    f"'{c}'" for c in [*_NUM, "season_unknown"]) + "]))"


@query("global_importance", f"SELECT feature, 'built_in_importance' AS method, TRUE AS in_range, TRUE AS sums_to_one FROM {_SLOTS}")
def global_importance(t):
    table = ml.importances(_forest(t), t.spark)
    total = table.agg(F.sum("importance")).scalar()
    return table.select("feature", "method", F.col("importance").between(0, 1).alias("in_range"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("topk_importance", f"SELECT CAST(k AS INTEGER) AS rank, TRUE AS named, TRUE AS descending FROM range(1, (SELECT least(10, count(*)) FROM {_SLOTS}) + 1) g(k)")
def topk_importance(t):
    model = _forest(t)
    top = ml.top_importances(ml.importances(model, t.spark))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")          # ten rows
    return top.select(F.row_number().over(order).alias("rank"), F.col("feature").isin(ml.feature_names(model)).alias("named"),
                      F.coalesce(F.lag("importance").over(order) >= F.col("importance"), F.lit(True)).alias("descending"))


@query("local_contributions", f"WITH {_HALVES}, long AS (" + " UNION ALL ".join(
    f"SELECT ordinal, '{c}' AS feature, {c} AS v FROM train" for c in _NUM) + f""")
SELECT ordinal, feature, {sql_r('v')} AS feature_value, 'global_importance' AS method, TRUE AS in_range FROM long""")
def local_contributions(t):
    out = ml.local_contributions(_halves(t)[0], ml.importances(_forest(t), t.spark), _NUM, "ordinal")
    return out.select("ordinal", "feature", r("feature_value").alias("feature_value"), "method", F.col("contribution").between(0, 1).alias("in_range"))


_MODELS = ", ".join(f"('{m}')" for m in (ml.LINEAR, ml.FOREST, ml.EXTRA, ml.BOOSTED))


@query("compare_models", f"SELECT model, TRUE AS fits, CAST(NULL AS VARCHAR) AS error FROM (VALUES {_MODELS}) m(model)")
def compare_models(t):
    train, test = _halves(t)
    return ml.compare_models(train, test, _NUM, "aqi").select("model", (F.col("r2") > 0.5).alias("fits"), "error")


@query("cross_validate", f"SELECT model, CAST(k AS INTEGER) AS fold, TRUE AS fits FROM (VALUES {_MODELS}) m(model), range(1, 6) g(k)")
def cross_validate(t):
    return ml.cross_validate(t.v_training, _NUM, "aqi", "ordinal").select("model", "fold", (F.col("r2") > 0.5).alias("fits"))


@query("fold_sizes", """SELECT CAST(CAST('0x' || substr(md5(CAST(ordinal AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n,
 sum(ordinal)::BIGINT AS ordinals FROM {v_training} GROUP BY 1""")
def fold_sizes(t):
    return ml.with_folds(t.v_training, "ordinal").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("ordinals"))


@query("tune_models", f"""SELECT model, CAST(n AS BIGINT) AS n_points, TRUE AS beats_mean FROM
 (VALUES ('{ml.FOREST}', 72), ('{ml.EXTRA}', 72), ('{ml.BOOSTED}', 162)) m(model, n)""")
def tune_models(t):
    """The expanded grid of 306 points, which the search takes from 100 rows on."""
    train, _ = _halves(t)
    prep = ml.fit_preprocessing(train, _NUM)
    frame = prep.transform(ml.as_doubles(train, _NUM)).select(F.col("ordinal").alias("id"), vector_to_array("features").alias("features"), F.col("aqi").alias("label"))
    spread = frame.agg(F.stddev_pop("label")).scalar()
    return ensembles.best_points(ensembles.search(frame)).select("model", "n_points", (F.col("best_rmse") < spread).alias("beats_mean"))


@query("model_flow", f"WITH {_HALVES} SELECT count(*) AS n, TRUE AS fits, TRUE AS unbiased FROM test")
def model_flow(t):
    _, metrics, scored = _flow(t)
    residuals = scoring.residual_summary(scoring.with_residuals(scored, "aqi"))
    return metrics.select("n", "r2", "rmse").join(residuals.select("n", "mean_residual", "std_residual"), "n").select(
        "n", (F.col("r2") > 0.9).alias("fits"), (F.abs("mean_residual") < F.col("rmse")).alias("unbiased"))
