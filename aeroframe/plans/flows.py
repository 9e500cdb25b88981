"""Cleaning, registry, integration, analysis and model flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from aeroframe import values as V
from aeroframe.functions import aqi as ax, time as tm, weather
from aeroframe.operators import align, clean, columns as cols, dedup, fill, filters, ml, profile, quality, scoring
from aeroframe.operators import spatial, split, stations as reg
from aeroframe.session import cut_lineage

SOURCE_COLUMNS = {"cpcb": ("station", "last_update"), "openaq": ("location", "utc_time")}   # fixed values

MERGED_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c in ("latitude", "longitude") else T.StringType()) for c in V.MERGED_KEYS]
    + [T.StructField(c, T.DoubleType()) for c in
       V.POLLUTANT_FEATURES + V.METEOROLOGY_FEATURES + V.SATELLITE_FEATURES]
    + [T.StructField("day_of_week", T.IntegerType()), T.StructField("month", T.IntegerType()),
       T.StructField("season", T.StringType()), T.StructField("weekend_flag", T.BooleanType()),
       T.StructField("satellite_match_distance_km", T.DoubleType()),
       T.StructField("era5_match_distance_km", T.DoubleType()),
       T.StructField("placeholder_used", T.BooleanType()), T.StructField("aqi", T.DoubleType())])


def clean_table(df: DataFrame, station: str, ts: str, ordinal: str = "ordinal",
                pollutants: Sequence[str] | None = None, ts_is_text: bool = False) -> DataFrame:
    """Rename, dates, exact de-duplication, first row per station and time, negatives, flags, units."""
    named = cols.rename_pollutant_columns(df)
    if ts_is_text:
        named = named.withColumn(ts, tm.iso_text(F.col(ts)))
    present = list(pollutants or [c for c in V.CLEANED_COLUMNS if c in named.columns])
    once = dedup.distinct_rows(named, ordinal)
    firsts = dedup.first_per_key(once, [station, ts], [F.col(ordinal)])
    kept = filters.drop_negative_rows(firsts, present)
    return cols.attach_units(clean.flag_outliers(kept, present))


def clean_source(df: DataFrame, source: str, ordinal: str = "ordinal") -> DataFrame:
    key = source.lower()
    if key not in SOURCE_COLUMNS:
        raise ValueError(f"unknown source: {source}")
    station, ts = SOURCE_COLUMNS[key]
    return clean_table(df, station, ts, ordinal, ts_is_text=True)


def attach_grid(obs: DataFrame, grid: DataFrame | None, features: Sequence[str], prefix: str,
                strategy: str = "nearest", ts: str = "ts", grid_ts: str = "timestamp",
                places: DataFrame | None = None) -> DataFrame:
    """Time first, then space: features of the nearest cell in the matching snapshot, and its distance.

    Matching runs on the distinct (place, time) pairs of ``places`` (by default ``obs`` itself) and is
    joined back. Without a grid the features and the distance are null.
    """
    distance = f"{prefix}_match_distance_km"
    if strategy not in V.TEMPORAL_STRATEGIES:
        raise ValueError(f"unknown temporal strategy: {strategy}")
    if grid is None:
        return obs.withColumns({**{f: F.lit(None).cast("double") for f in features},
                                distance: F.lit(None).cast("double")})
    absent = [f for f in features if f not in grid.columns]
    if absent:
        grid = grid.withColumns({f: F.lit(None).cast("double") for f in absent})
    order = ("ordinal",)
    if strategy == "nearest":
        place = align.time_placer(grid, ts, grid_ts)
        cells = grid.withColumn("snapshot_ts", F.col(grid_ts).cast("timestamp"))
    elif strategy == "hourly":
        place = lambda df: df.withColumn("snapshot_ts", F.date_trunc("hour", F.col(ts)))
        cells = grid.withColumn("snapshot_ts", F.date_trunc("hour", F.col(grid_ts)))
    else:
        place = lambda df: df.withColumn("snapshot_ts", F.date_trunc("day", F.col(ts)))
        cells = align.cell_day_means(grid, features, grid_ts, "latitude", "longitude").withColumn(
            "snapshot_ts", F.col(grid_ts))
        order = ("latitude", "longitude")
    narrow = (obs if places is None else places).select(ts, "latitude", "longitude")
    asked = place(narrow).where(F.col("snapshot_ts").isNotNull())
    matched = spatial.nearest_cell(asked, cells, features, "snapshot_ts", order)
    renamed = matched.withColumnsRenamed({"match_distance_km": distance})
    return (place(obs).join(renamed, ["snapshot_ts", "latitude", "longitude"], "left")
            .select(*obs.columns, *features, distance))


def integrate(obs: DataFrame, stations: DataFrame, satellite: DataFrame | None, weather_grid: DataFrame | None,
              temporal: str = "nearest", missing: str = "leave_missing", ts: str = "ts",
              ordinal: str = "ordinal", chunk: str = "day") -> DataFrame:
    """Observations with registry, gridded features, derived features and the chosen fill, in fixed columns.

    ``chunk`` is the time unit that splits a station's series in the fill.
    """
    merged = reg.join_station_metadata(obs, stations)
    places = merged.select(ts, "latitude", "longitude")      # both grids are matched from here
    merged = attach_grid(merged, satellite, V.SATELLITE_FEATURES, "satellite", temporal, ts, places=places)
    raw_wind = weather_grid is not None and {"u_wind", "v_wind"} <= set(weather_grid.columns)
    wanted = [*V.METEOROLOGY_FEATURES, *(["u_wind", "v_wind"] if raw_wind else [])]
    merged = attach_grid(merged, weather_grid, wanted, "era5", temporal, ts, places=places)
    built = {**tm.calendar_columns(F.col(ts)), **{k: v for k, v in tm.time_keys(F.col(ts)).items() if k in ("date", "time")}}
    if raw_wind:
        built["wind_speed"] = weather.wind_speed(F.col("u_wind"), F.col("v_wind"))
        built["wind_direction"] = weather.wind_direction(F.col("u_wind"), F.col("v_wind"))
    table = merged.withColumns(built)
    numeric = [c for c in V.POLLUTANT_FEATURES + V.METEOROLOGY_FEATURES + V.SATELLITE_FEATURES if c in table.columns]
    table = fill.apply_strategy(table, missing, numeric, "station_id", ts, ordinal, chunk=chunk)
    table = table.withColumn("placeholder_used", F.lit(satellite is None or weather_grid is None))
    kept = T.StructType([T.StructField(ordinal, T.LongType()), *MERGED_SCHEMA.fields])
    return cols.ensure_columns(table, kept)


def analysis_table(merged: DataFrame, target: str = "aqi", **options) -> DataFrame:
    """Collocated rows of a merged table that has a target; fails without one (an action checks it)."""
    if target not in merged.columns:
        raise ValueError(f"target column {target} is missing")
    judged = quality.collocate(merged, **options)
    kept = judged.where(F.col("reason_code").isNull()).drop("reason_code")
    if kept.where(F.col(target).isNotNull()).limit(1).count() == 0:
        raise ValueError(f"target column {target} has no values")
    return kept


def reconstruct_target(df: DataFrame, target: str = "aqi") -> DataFrame:
    """Existing target if it has any value, else the index computed per row without the minimum rule."""
    pollutants = {p: c for p, c in V.POLLUTANT_COLUMNS.items() if c in df.columns}
    if target not in df.columns and not pollutants:
        raise ValueError("no target and no pollutant columns")
    if not pollutants:
        return df
    held = df.withColumnRenamed(target, "_given") if target in df.columns else df.withColumn("_given", F.lit(None))
    computed = ax.with_index(held, pollutants)
    given = held.agg(F.count("_given").alias("n")).scalar()
    chosen = F.when(given > 0, F.col("_given").cast("double")).otherwise(F.col("aqi").cast("double"))
    names = [c for c in df.columns if c != target]
    return computed.select(*names, chosen.alias(target))


def feature_selection(df: DataFrame, features: Sequence[str], target: str, importance: DataFrame | None = None) -> DataFrame:
    """Ranked features with their correlation to the target, importance and collinear partners dropped."""
    r = profile.target_correlations(df, features, target)
    if importance is not None:
        r = r.join(importance.select("feature", "importance"), "feature", "left")
    else:
        r = r.withColumn("importance", F.lit(0.0))
    ranking = profile.rank_features(r)
    pairs = profile.collinear_pairs(profile.correlation_matrix(df, features), ranking)
    lost = pairs.groupBy(F.col("drop").alias("feature")).agg(F.count(F.lit(1)).alias("n_collinear"))
    return ranking.join(lost, "feature", "left").withColumn("n_collinear", F.coalesce("n_collinear", F.lit(0)))


def train_and_score(df: DataFrame, numeric: Sequence[str], target: str, ts: str, ordinal: str,
                    n_trees: int = 100, depth: int = 12) -> tuple[object, DataFrame, DataFrame]:
    """Range check, chronological split, fit on train, score on test: (model, metrics, scored rows).

    Test rows are scored once and kept, since metrics and callers read them several times.
    """
    failed = quality.feature_range_check(df).where("status = 'FAILED'").limit(1).count()
    if failed:
        raise ValueError("feature check failed: a registered column holds values of the wrong type")
    labelled = split.holdout_split(df.where(F.col(target).isNotNull()), ts, ordinal)
    model = ml.train_forest(labelled.where("split = 'train'"), numeric, target, n_trees=n_trees, depth=depth)
    scored = cut_lineage(ml.score(model, labelled.where("split = 'test'"), numeric))
    return model, scoring.regression_metrics(scored, actual=target), scored


def station_day_index(long: DataFrame) -> DataFrame:
    """Long observations to one row per station and day with index, leading pollutant and category."""
    dated = long.withColumn("obs_date", F.to_date("ts"))
    wide = clean.pivot_first(dated, ["station_id", "obs_date"], {
        p: V.POLLUTANT_COLUMNS[p] for p in ("PM2.5", "PM10", "NO2", "SO2", "O3")})
    indexed = ax.with_index(wide)
    return indexed.withColumn("category", ax.category(F.col("aqi")))
