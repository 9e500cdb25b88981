"""Temporal matching of observations to gridded data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from aeroframe import values as V


def nearest_times(moments: DataFrame, grid: DataFrame, grid_ts: str, unit: str = "hour") -> DataFrame:
    """(moment, snapshot_ts) for the distinct times in the single column ``moment``: the grid time nearest to each.

    Both kinds of times are sorted together inside time chunks of the given unit; the last grid time before
    a chunk and the first one after it come from a summary with one row per chunk. So the spacing of the
    grid does not matter, and a task never holds more than the distinct times of one chunk. A moment
    halfway between two grid times goes to the earlier one.

    What follows a row is read in falling order: Spark carries a frame that begins at the first row from
    row to row, but walks one that ends at the last row anew for each.
    """
    asked = moments.where(F.col("moment").isNotNull()).select("moment", F.lit(False).alias("_grid"))
    times = grid.where(F.col(grid_ts).isNotNull()).select(F.col(grid_ts).cast("timestamp").alias("moment"), F.lit(True).alias("_grid"))
    both = asked.unionByName(times).groupBy("moment").agg(F.max("_grid").alias("_grid"), F.min("_grid").alias("_only"))
    both = both.withColumn("_chunk", F.date_trunc(unit, "moment"))
    at = F.when(F.col("_grid"), F.col("moment"))

    # one row per chunk of time that holds anything: a century of hours is 876,600 rows
    earlier, later = (Window.partitionBy(F.lit(0)).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_chunk"), F.desc("_chunk")))
    chunks = both.groupBy("_chunk").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    chunks = chunks.select(
        F.col("_chunk").alias("_c"),
        F.last("_last", ignorenulls=True).over(earlier).alias("_before"),
        F.last("_first", ignorenulls=True).over(later).alias("_after"))

    upto, down_to = (Window.partitionBy("_chunk").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("moment"), F.desc("moment")))
    placed = both.withColumns({
        "_prev": F.last(at, ignorenulls=True).over(upto),
        "_next": F.last(at, ignorenulls=True).over(down_to)})
    placed = placed.where(~F.col("_only")).join(chunks, F.col("_chunk") == F.col("_c"), "left")
    prev, after = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    nearer = F.unix_micros("moment") * 2 <= F.unix_micros(prev) + F.unix_micros(after)
    return placed.select("moment", F.when(after.isNull() | nearer, prev).otherwise(after).alias("snapshot_ts"))


def time_placer(grid: DataFrame, ts: str, grid_ts: str, unit: str = "hour") -> Callable[[DataFrame], DataFrame]:
    """Function that adds ``snapshot_ts``, the grid time nearest to ``ts`` (earlier on a tie).

    Only distinct times are sorted; rows meet theirs in an equi-join.
    """
    moment = F.col(ts).cast("timestamp")

    def place(df: DataFrame) -> DataFrame:
        known = nearest_times(df.select(moment.alias("moment")).distinct(), grid, grid_ts, unit)
        return df.join(known, moment == F.col("moment"), "left").select(*df.columns, "snapshot_ts")

    return place


def asof_nearest_time(obs: DataFrame, grid: DataFrame, ts: str = "ts", grid_ts: str = "grid_ts",
                      unit: str = "hour") -> DataFrame:
    """Add ``snapshot_ts``: the grid time nearest to each observation."""
    return time_placer(grid, ts, grid_ts, unit)(obs)


def asof_features(obs: DataFrame, grid: DataFrame, features: Sequence[str], ts: str = "ts", grid_ts: str = "grid_ts",
                  ordinal: str = "ordinal", unit: str = "hour") -> DataFrame:
    """Add the time and the features of the grid row nearest in time.

    Of several grid rows at one time an observation at or after it takes the last, an earlier one the first.
    """
    row = F.struct(*[F.col(f) for f in features])
    rows = grid.groupBy(F.col(grid_ts).cast("timestamp").alias("_at")).agg(
        F.min_by(row, ordinal).alias("_head"), F.max_by(row, ordinal).alias("_tail"))
    placed = asof_nearest_time(obs, grid, ts, grid_ts, unit).join(rows, F.col("snapshot_ts") == F.col("_at"), "left")
    late = F.col(ts).cast("timestamp") >= F.col("snapshot_ts")
    kept = [c for c in obs.columns if c not in features]
    return placed.select(*kept, "snapshot_ts", *[
        F.when(late, F.col(f"_tail.{f}")).otherwise(F.col(f"_head.{f}")).alias(f) for f in features])


def align_hourly(obs: DataFrame, grid: DataFrame, features: Sequence[str], ts: str = "ts",
                 grid_ts: str = "grid_ts") -> DataFrame:
    """Mean of all grid rows in the observation's hour."""
    return _align_mean(obs, grid, features, ts, grid_ts, "hour")


def align_daily(obs: DataFrame, grid: DataFrame, features: Sequence[str], ts: str = "ts",
                grid_ts: str = "grid_ts") -> DataFrame:
    """Mean of all grid rows on the observation's day."""
    return _align_mean(obs, grid, features, ts, grid_ts, "day")


def _align_mean(obs, grid, features, ts, grid_ts, unit):
    means = grid.groupBy(F.date_trunc(unit, F.col(grid_ts)).alias("_at")).agg(*[F.avg(f).alias(f) for f in features])
    keyed = obs.withColumn("_at", F.date_trunc(unit, F.col(ts)))
    return keyed.join(means, "_at", "left").drop("_at")


def cell_day_means(grid: DataFrame, features: Sequence[str], grid_ts: str = "grid_ts",
                   lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Mean per cell and day; the row is stamped with the day."""
    return grid.groupBy(F.date_trunc("day", F.col(grid_ts)).alias(grid_ts), lat, lon).agg(
        *[F.avg(f).alias(f) for f in features])


def match_reference_times(obs: DataFrame, references: DataFrame, ts: str = "ts", reference_ts: str = "ref_ts",
                          tolerance_hours: float = V.TEMPORAL_TOLERANCE_HOURS) -> DataFrame:
    """Rows whose nearest reference time lies within the tolerance, bounds included."""
    near = asof_nearest_time(obs, references, ts, reference_ts)
    gap = F.abs(F.unix_micros("snapshot_ts") - F.unix_micros(F.col(ts).cast("timestamp")))
    return near.where(gap / 3.6e9 <= tolerance_hours).select(*obs.columns)
