"""Checks of merged tables, rejection with reasons and collocation."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from aeroframe import values as V
from aeroframe.functions import geo, time as tm
from aeroframe.operators.columns import numeric_columns
from aeroframe.operators.dedup import first_per_key, mark_first
from aeroframe.operators.orderstat import upper_median_time
from aeroframe.operators.sizes import attach_row


# -- rejection -------------------------------------------------------------------------------

def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


_DISTANCES = {"satellite_distance": "satellite_match_distance_km", "era5_distance": "era5_match_distance_km"}


def _worded(template: str, tolerance_km: float) -> Column:
    """A reason text with the row's values in its places; distances have two decimals."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name in _DISTANCES.values():
            parts.append(F.format_string("%.2f", F.col(name).try_cast("double")))
        elif name == "tolerance_km":
            parts.append(F.lit(str(tolerance_km)))
        elif name:
            parts.append(_text(name))
    return F.concat(*parts)


def reject_invalid(df: DataFrame, tolerance_km: float = V.SPATIAL_TOLERANCE_KM, ordinal: str = "ordinal") -> DataFrame:
    """Add ``reason_code`` and ``reason``: the first check a row fails; null for accepted rows.

    Duplicates are judged among the rows that passed the earlier checks, so the kept first row of a
    station-time may still fail on distance.
    """
    absent = [c for c in V.COLLOCATION_COLUMNS if c not in df.columns]
    if absent:
        return df.withColumns({
            "reason_code": F.lit("absent_column"),
            "reason": F.lit(f"Required column '{absent[0]}' absent from dataset")})
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    moment = tm.parse_date_time(F.col("date").cast("string"), F.col("time").cast("string"))
    early = (
        F.when(moment.isNull(), "bad_timestamp")
        .when(F.col("latitude").isNull() | F.col("longitude").isNull(), "missing_coordinate")
        .when(lat.isNull() | lon.isNull(), "non_numeric_coordinate")
        .when(~geo.in_world(lat, lon), "outside_world")
        .when(~geo.in_box(lat, lon, V.INDIA_REJECT_BOX), "outside_region"))
    staged = df.withColumn("_early", early)
    marked = mark_first(staged, ["station_id", "date", "time"], ordinal, "_first", where=F.col("_early").isNull())
    code = F.coalesce(F.col("_early"), F.when(~F.col("_first"), "duplicate_station_time"))
    for name, column in _DISTANCES.items():
        if column in df.columns:
            code = F.coalesce(code, F.when(F.col(column).try_cast("double") > tolerance_km, name))
    present = set(df.columns)
    reasons = {name: _worded(text, tolerance_km) for name, text in V.REASON_TEXTS.items()
               if name not in _DISTANCES or _DISTANCES[name] in present}
    judged = marked.withColumn("reason_code", code)
    wording = None
    for name, words in reasons.items():
        hit = F.col("reason_code") == name
        wording = F.when(hit, words) if wording is None else wording.when(hit, words)
    return judged.withColumn("reason", wording).select(*df.columns, "reason_code", "reason")


def within_time(df: DataFrame, ts: str, tolerance_hours: float = V.TEMPORAL_TOLERANCE_HOURS,
                reference: Column | None = None) -> DataFrame:
    """Add boolean ``accepted``: inside the tolerance round a reference, or round the upper median."""
    centre = upper_median_time(df, ts).scalar() if reference is None else reference
    gap = F.abs(F.unix_micros(F.col(ts)) - F.unix_micros(centre))
    return df.withColumn("accepted", F.coalesce(gap <= F.lit(int(tolerance_hours * 3.6e9)), F.lit(False)))


def within_radius(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                  tolerance_km: float = V.SPATIAL_TOLERANCE_KM,
                  reference: tuple[float, float] | None = None) -> DataFrame:
    """Add boolean ``accepted``: inside the radius round a reference, or round the mean coordinate."""
    if lat not in df.columns or lon not in df.columns:
        return df.withColumn("accepted", F.lit(True))
    y, x = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    if reference is None:
        both = y.isNotNull() & x.isNotNull()
        df = attach_row(df, df.agg(F.avg(F.when(both, y)).alias("y"), F.avg(F.when(both, x)).alias("x")), "_centre")
        y0, x0 = F.col("_centre.y"), F.col("_centre.x")
    else:
        y0, x0 = F.lit(reference[0]), F.lit(reference[1])
    km = geo.haversine_km(y, x, y0, x0, V.EARTH_RADIUS_TOLERANCE_KM)
    return df.withColumn("accepted", F.coalesce(km <= tolerance_km, F.lit(False))).drop("_centre")


def earliest_per_station_day(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    moment = tm.parse_date_time(F.col("date"), F.col("time"))
    return first_per_key(df, ["station_id", "date"], [moment.asc_nulls_last(), F.col(ordinal)])


def collocate(df: DataFrame, stations: DataFrame | None = None, tolerance_km: float = V.SPATIAL_TOLERANCE_KM,
              tolerance_hours: float = V.TEMPORAL_TOLERANCE_HOURS, reference_time: Column | None = None,
              reference_point: tuple[float, float] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Every row of the wanted stations with the stage that dropped it (``reason_code``, null = kept).

    Stages: rejection, optional time window, optional radius, earliest row per station and day.
    """
    if stations is not None:
        df = df.join(stations.select("station_id").distinct(), "station_id", "left_semi")
    judged = reject_invalid(df, tolerance_km, ordinal).withColumn(
        "_moment", tm.parse_date_time(F.col("date"), F.col("time")))
    code = F.col("reason_code")
    if reference_time is not None:
        gap = F.abs(F.unix_micros("_moment") - F.unix_micros(reference_time))
        code = F.coalesce(code, F.when(gap > F.lit(int(tolerance_hours * 3.6e9)), "outside_time_window"))
    if reference_point is not None:
        km = geo.haversine_km(F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double"),
                              F.lit(reference_point[0]), F.lit(reference_point[1]), V.EARTH_RADIUS_TOLERANCE_KM)
        code = F.coalesce(code, F.when(km > tolerance_km, "outside_radius"))
    judged = judged.withColumn("reason_code", code)
    # first of the day in (time, input) order: two map-side combined minima, then a lookup by ordinal
    kept = judged.where(F.col("reason_code").isNull())
    first = kept.groupBy("station_id", "date").agg(
        F.min(F.struct("_moment", ordinal)).alias("_m")).select(
        F.col(f"_m.{ordinal}").alias(ordinal), F.lit(True).alias("_earliest"))
    out = judged.join(first, ordinal, "left")
    code = F.coalesce(F.col("reason_code"), F.when(F.col("_earliest").isNull(), "not_nearest_of_day"))
    return out.withColumn("reason_code", code).select(*df.columns, "reason_code")


def collocation_summary(judged: DataFrame) -> DataFrame:
    """Counts after each stage, station counts and status in one row."""
    code = F.coalesce(F.col("reason_code"), F.lit("kept"))
    after_reject = code.isin("kept", "not_nearest_of_day", "outside_time_window", "outside_radius")
    after_time = code.isin("kept", "not_nearest_of_day", "outside_radius")
    after_radius = code.isin("kept", "not_nearest_of_day")
    kept = code == "kept"
    per_station = judged.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(after_reject).alias("r"), F.count_if(after_time).alias("t"),
        F.count_if(after_radius).alias("s"), F.count_if(kept).alias("k"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_station.agg(
        total("n").alias("input_rows"), F.count("station_id").alias("input_stations"),
        total("r").alias("after_rejection"), total("t").alias("after_time"), total("s").alias("after_radius"),
        total("k").alias("collocated_rows"),
        F.count_if((F.col("k") > 0) & F.col("station_id").isNotNull()).alias("collocated_stations"),
    ).withColumn("status", F.when(F.col("collocated_rows") > 0, "SUCCESS").otherwise("EMPTY"))


# -- table checks ------------------------------------------------------------------------------

def required_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(check, status, detail) from the schema alone."""
    missing = [c for c in V.REQUIRED_COLUMNS if c not in df.columns]
    thin = [c for c in V.EXPECTED_COLUMNS if c not in df.columns and c not in missing]
    status = "FAILED" if missing else "WARNING" if thin else "PASSED"
    return [("required_columns", status, ",".join(missing or thin))]


def column_types(df: DataFrame) -> list[tuple[str, str, str]]:
    numeric = set(numeric_columns(df))
    kinds = {c: kind for c, _, _, kind, *_ in V.FEATURES}
    kinds.update({"city": "string", "state": "string", "satellite_match_distance_km": "numeric",
                  "era5_match_distance_km": "numeric"})
    wrong = []
    for f in df.schema:
        kind = kinds.get(f.name)
        text = isinstance(f.dataType, T.StringType)
        flag = isinstance(f.dataType, T.BooleanType)
        if (kind == "numeric" and f.name not in numeric) or (kind in ("string", "categorical") and not text) or (
                kind == "boolean" and not flag and f.name not in numeric):
            wrong.append(f.name)
    return [("dtypes", "FAILED" if wrong else "PASSED", ",".join(wrong))]


def null_percentages(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """(column_name, n_null, null_pct) from one aggregate."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col("_n") - F.col(c)).alias("n_null")) for c in columns]))
    long = one.select("_n", cells.alias("_c")).select("_n", "_c.*")
    pct = F.when(F.col("_n") > 0, F.bround(F.col("n_null") / F.col("_n") * 100.0, digits)).otherwise(F.lit(0.0))
    return long.select("column_name", "n_null", pct.alias("null_pct"))


def missing_values_check(df: DataFrame) -> DataFrame:
    """Null counts per column with the column's own verdict."""
    verdict = (F.when(F.col("column_name").isin(V.CRITICAL_COLUMNS) & (F.col("n_null") > 0), "FAILED")
               .when(~F.col("column_name").isin(V.PLACEHOLDER_COLUMNS) & (F.col("null_pct") > 20.0), "WARNING")
               .otherwise("PASSED"))
    return null_percentages(df).withColumn("status", verdict)


def timestamp_flags(now: Column) -> dict[str, Column]:
    day, clock = tm.parse_date(F.col("date")), tm.parse_clock(F.col("time"))
    moment = F.timestamp_seconds(F.unix_timestamp(day) + clock)
    future = moment > now + F.expr("interval 1 hour")
    return {"bad_date": day.isNull(), "bad_time": clock.isNull(), "in_future": F.coalesce(future, F.lit(False))}


def timestamps_check(df: DataFrame, now: Column) -> DataFrame:
    flags = timestamp_flags(now)
    counted = df.agg(*[F.count_if(test).alias(name) for name, test in flags.items()])
    worst = sum(F.col(n) for n in flags)
    return counted.withColumn("status", F.when(worst > 0, "FAILED").otherwise("PASSED"))


def coordinate_flags() -> dict[str, Column]:
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    bad = ~F.coalesce(geo.in_world(lat, lon), F.lit(False))
    return {"invalid": bad, "outside_region": ~bad & ~geo.in_box(lat, lon, V.INDIA_REJECT_BOX)}


def coordinates_check(df: DataFrame) -> DataFrame:
    counted = df.agg(*[F.count_if(test).alias(name) for name, test in coordinate_flags().items()])
    return counted.withColumn("status", F.when(F.col("invalid") > 0, "FAILED")
                              .when(F.col("outside_region") > 0, "WARNING").otherwise("PASSED"))


def duplicate_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_rows, n_repeats): rows beyond the first per key; copies combine on the map side."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                     F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeats"))


def _single(check: str, counted: DataFrame, n: Column, status: Column) -> DataFrame:
    return counted.select(F.lit(check).alias("check"), status.alias("status"), n.cast("long").alias("n_found"))


def validate_table(df: DataFrame, now: Column, ordinal: str | None = None) -> DataFrame:
    """Seven checks and the overall verdict as rows (check, status, n_found)."""
    spark = df.sparkSession
    body = df.drop(ordinal) if ordinal else df
    shape = [(name, status, len([d for d in detail.split(",") if d]))
             for name, status, detail in required_columns(body) + column_types(body)]
    parts = [spark.createDataFrame(shape, "check string, status string, n_found long")]

    # missing values, timestamps and coordinates share one pass
    flags = {**timestamp_flags(now), **coordinate_flags()}
    one = body.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_v_{c}") for c in body.columns],
                   *[F.count_if(t).alias(f"_f_{k}") for k, t in flags.items()])
    null = {c: F.col("_n") - F.col(f"_v_{c}") for c in body.columns}
    critical = sum(F.when(null[c] > 0, 1).otherwise(0) for c in body.columns if c in V.CRITICAL_COLUMNS)
    pct = lambda c: F.bround(F.when(F.col("_n") > 0, null[c] / F.col("_n") * 100.0).otherwise(0.0), 4)
    thin = sum(F.when(pct(c) > 20.0, 1).otherwise(0) for c in body.columns if c not in V.PLACEHOLDER_COLUMNS)
    f = {k: F.col(f"_f_{k}") for k in flags}
    times = f["bad_date"] + f["bad_time"] + f["in_future"]
    verdicts = F.array(
        F.struct(F.lit("missing_values").alias("check"),
                 F.when(critical > 0, "FAILED").when(thin > 0, "WARNING").otherwise("PASSED").alias("status"),
                 F.when(critical > 0, critical).otherwise(thin).cast("long").alias("n_found")),
        F.struct(F.lit("timestamps").alias("check"),
                 F.when(times > 0, "FAILED").otherwise("PASSED").alias("status"), times.cast("long").alias("n_found")),
        F.struct(F.lit("coordinates").alias("check"),
                 F.when(f["invalid"] > 0, "FAILED").when(f["outside_region"] > 0, "WARNING").otherwise("PASSED").alias("status"),
                 F.when(f["invalid"] > 0, f["invalid"]).otherwise(f["outside_region"]).cast("long").alias("n_found")))
    parts.append(one.select(F.explode(verdicts).alias("_v")).select("_v.*"))

    failing = lambda: F.when(F.col("n_repeats") > 0, "FAILED").otherwise("PASSED")
    parts.append(_single("duplicate_rows", duplicate_totals(body, body.columns), F.col("n_repeats"), failing()))
    key = next((c for c in ("station_id", "station_name") if c in body.columns), None)
    keys = [c for c in (key, "date", "time") if c and c in body.columns]
    if len(keys) >= 2:
        parts.append(_single("duplicate_station_time", duplicate_totals(body, keys), F.col("n_repeats"), failing()))
    else:
        parts.append(spark.createDataFrame([("duplicate_station_time", "WARNING", 0)],
                                           "check string, status string, n_found long"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    severity = (F.when(F.col("status") == "FAILED", 2).when(F.col("status") == "WARNING", 1).otherwise(0))
    verdict = rows.agg(F.max(severity).alias("s"), F.count_if(F.col("status") != "PASSED").alias("n")).select(
        F.lit("overall").alias("check"),
        F.element_at(F.array(F.lit("PASSED"), F.lit("WARNING"), F.lit("FAILED")), F.col("s") + 1).alias("status"),
        F.col("n").alias("n_found"))
    return rows.unionByName(verdict)


def validate_grid(df: DataFrame, variables: Sequence[str], ts: str = "timestamp",
                  lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Grid table checks as rows (check, status, n_found): repeats only warn."""
    absent = [c for c in (ts, lat, lon, *variables) if c not in df.columns]
    if absent:
        return df.sparkSession.createDataFrame(
            [("columns", "FAILED", len(absent))], "check string, status string, n_found long")
    sizes = df.groupBy(ts, lat, lon).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"_{v}") for v in variables])
    one = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeats"),
                    F.sum(F.when(F.col(lat).isNull() | F.col(lon).isNull(), F.col("n"))).alias("no_place"),
                    *[F.sum(f"_{v}").alias(f"_{v}") for v in variables])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    empty_vars = sum(F.when(n(f"_{v}") == 0, 1).otherwise(0) for v in variables)
    checks = [("empty", F.when(n("rows") == 0, 1).otherwise(0), "FAILED"), ("duplicates", n("repeats"), "WARNING"),
              ("null_coordinates", n("no_place"), "FAILED"), ("empty_variables", empty_vars, "FAILED")]
    cells = F.array(*[F.struct(F.lit(name).alias("check"),
                               F.when(found > 0, bad).otherwise("PASSED").alias("status"),
                               found.cast("long").alias("n_found")) for name, found, bad in checks])
    return one.select(F.explode(cells).alias("_c")).select("_c.*")


# -- features ------------------------------------------------------------------------------------

def value_ok(feature: str) -> Column:
    """Whether a value fits the registered type and range of its feature; null always does."""
    kind, low, high = next((f[3], f[6], f[7]) for f in V.FEATURES if f[0] == feature)
    given = F.col(feature)
    if kind == "numeric":
        x = given.try_cast("double")
        fits = F.coalesce(x.between(low, high), F.lit(False))
    elif kind == "boolean":
        fits = F.lower(given.cast("string")).isin("true", "false", "0", "1")
    else:
        fits = F.lit(True)
    return given.isNull() | fits


def feature_range_check(df: DataFrame) -> DataFrame:
    """Per registered feature: presence, null share, values out of range, type verdict."""
    present = [f for f in V.FEATURES if f[0] in df.columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c, _, _, kind, _, _, low, high in present:
        aggs.append(F.count(c).alias(f"_v_{c}"))
        x = F.col(c).try_cast("double")
        if kind == "numeric":
            aggs.append(F.count_if((x < low) | (x > high)).alias(f"_r_{c}"))
            aggs.append(F.count_if(F.col(c).isNotNull() & x.isNull()).alias(f"_t_{c}"))
        elif kind == "boolean":
            ok = F.lower(F.col(c).cast("string")).isin("true", "false", "0", "1", "0.0", "1.0")
            aggs.append(F.count_if(~ok).alias(f"_t_{c}"))
    one = df.agg(*aggs)
    cells = []
    for c, _, group, kind, *_ in V.FEATURES:
        here = c in df.columns
        value = F.col(f"_v_{c}") if here else None
        pct = F.bround((F.col("_n") - value) / F.col("_n") * 100.0, 2) if here else F.lit(None).cast("double")
        off = F.col(f"_r_{c}") if here and kind == "numeric" else F.lit(0).cast("long")
        typed = F.col(f"_t_{c}") if here and kind in ("numeric", "boolean") else F.lit(0).cast("long")
        cells.append(F.struct(
            F.lit(c).alias("feature"), F.lit(group).alias("feature_group"), F.lit(here).alias("present"),
            F.when(F.col("_n") > 0, pct).alias("null_pct"), off.alias("out_of_range"), typed.alias("type_mismatch"),
            F.when(typed > 0, "FAILED").otherwise("PASSED").alias("status")))
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def target_stages(stages: dict[str, DataFrame], target: str = "aqi") -> DataFrame:
    """Presence, rows, non-null and null count of the target at each stage."""
    rows = None
    for name, df in stages.items():
        here = target in df.columns
        part = df.agg(F.count(F.lit(1)).alias("n_rows"),
                      (F.count(target) if here else F.lit(0).cast("long")).alias("n_known"))
        part = part.select(F.lit(name).alias("stage"), F.lit(here).alias("present"), "n_rows", "n_known",
                           (F.col("n_rows") - F.col("n_known")).alias("n_null"),
                           F.when(F.lit(here) & (F.col("n_known") > 0), "OK").otherwise("ERROR").alias("status"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _known_counts(stage: str, df: DataFrame | None, features: Sequence[str], spark) -> DataFrame:
    present = [c for c in features if df is not None and c in df.columns]
    if not present:
        return spark.createDataFrame([], "feature string, stage string, n_known long")
    one = df.agg(*[F.count(c).alias(c) for c in present])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(stage).alias("stage"),
                               F.col(c).alias("n_known")) for c in present])
    return one.select(F.explode(cells).alias("_c")).select("_c.*")


def lineage_registry(spark) -> DataFrame:
    return spark.createDataFrame(V.LINEAGE, "feature string, category string, pending boolean, used_by_model boolean")


def lineage_audit(spark, raw: DataFrame | None, cleaned: DataFrame | None, merged: DataFrame | None,
                  analysis: DataFrame | None, train: DataFrame | None,
                  satellite_present: bool, weather_present: bool) -> DataFrame:
    """Registered features by stage: PASS, FAIL, WAITING, PENDING or N/A, and the overall status."""
    names = [f for f, *_ in V.LINEAGE]
    tables = {"raw": raw, "cleaned": cleaned, "merged": merged, "analysis": analysis, "train": train}
    counts = None
    for stage, df in tables.items():
        part = _known_counts(stage, df, names, spark)
        counts = part if counts is None else counts.unionByName(part)
    # one row per registered feature: bounded by the registry
    wide = counts.groupBy("feature").agg(*[
        F.max(F.when(F.col("stage") == s, F.col("n_known"))).alias(s) for s in tables])
    reg = lineage_registry(spark).join(wide, "feature", "left")

    category, pending = F.col("category"), F.col("pending")
    waits = (F.lit(not satellite_present) & (category == "Satellite")) | (
        F.lit(not weather_present) & (category == "Meteorology"))
    gridded = category.isin("Satellite", "Meteorology")
    status = (F.when(pending, "Pending Implementation")
              .when(waits, "Waiting for Data")
              .when(F.col("analysis").isNull(), "Waiting for Data")
              .when((F.col("analysis") == 0) & gridded, "Waiting for Data")
              .otherwise("Available"))
    probe = lambda c: F.when(pending, "PENDING").when(F.coalesce(F.col(c), F.lit(0)) > 0, "PASS").otherwise("FAIL")
    pollutant = category == "Pollutant"
    out = reg.withColumn("status", status)
    waiting = F.col("status") == "Waiting for Data"
    late = lambda c: F.when((probe(c) == "FAIL") & waiting, "WAITING").otherwise(probe(c))
    model = (F.when(pending, "PENDING").when(~F.col("used_by_model"), "N/A").when(waiting, "WAITING")
             .when(F.col("train").isNull() | (F.col("train") > 0), "PASS").otherwise("WAITING"))
    return out.select(
        "feature", "category", "status", "used_by_model",
        F.when(pollutant, probe("raw")).when(pending, "PENDING").otherwise("N/A").alias("raw_stage"),
        F.when(pollutant, probe("cleaned")).when(category == "Static GIS", "PENDING").otherwise("N/A").alias("cleaned_stage"),
        F.when(waits & (F.col("merged") == 0), "WAITING").otherwise(probe("merged")).alias("features_stage"),
        late("analysis").alias("builder_stage"), late("analysis").alias("analysis_stage"),
        model.alias("model_stage"))


def lineage_totals(audit: DataFrame) -> DataFrame:
    reaches = F.col("used_by_model") & (F.col("status") == "Available")
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n_features"),
                                       F.count_if(reaches).alias("n_reaching_model"))


def pretrain_check(df: DataFrame) -> DataFrame:
    """ERROR for model features that are missing or all null, INFO for pending ones."""
    spark = df.sparkSession
    known = _known_counts("table", df, [f for f, *_ in V.LINEAGE], spark).select("feature", "n_known")
    joined = lineage_registry(spark).join(known, "feature", "left")
    level = F.when(F.col("pending"), "INFO").when(
        F.col("used_by_model") & (F.coalesce("n_known", F.lit(0)) == 0), "ERROR")
    issue = (F.when(F.col("pending"), "pending").when(F.col("n_known").isNull(), "missing")
             .when(F.col("n_known") == 0, "all_null"))
    return joined.select("feature", level.alias("level"), issue.alias("issue")).where(F.col("level").isNotNull())
