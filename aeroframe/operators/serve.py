"""The read queries behind dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aeroframe.functions import aqi as ax


def daily_summary(readings: DataFrame, region: str = "region", day: str = "obs_date") -> DataFrame:
    """Mean, highest and lowest index per region and day, active stations and leading pollutant."""
    top = F.max(F.struct(F.col("aqi"), F.col("dominant")))
    return readings.where(F.col("aqi").isNotNull()).groupBy(region, day).agg(
        F.bround(F.avg("aqi"), 1).alias("avg_aqi"), F.max("aqi").alias("max_aqi"), F.min("aqi").alias("min_aqi"),
        F.count(F.lit(1)).alias("n_readings"), F.count_distinct("station_id").alias("station_count"),
        top.getField("dominant").alias("dominant_pollutant"))


def category_distribution(df: DataFrame, index: str = "aqi") -> DataFrame:
    named = df.where(F.col(index).isNotNull()).select(ax.category(F.col(index)).alias("category"))
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "severity", ax.category_order(F.col("category")))


def fire_hourly_timeline(fires: DataFrame) -> DataFrame:
    return fires.groupBy(F.date_trunc("hour", "detected_at").alias("hour_ts")).agg(
        F.count("frp").alias("n_fires"), F.sum("frp").alias("total_frp"))


def fire_kpis(fires: DataFrame) -> DataFrame:
    return fires.agg(
        F.count(F.lit(1)).alias("n_fires"), F.coalesce(F.sum("frp"), F.lit(0.0)).alias("total_frp"),
        F.count_if(F.col("confidence") == "high").alias("n_high"), F.count_distinct("land_cover").alias("n_covers"))


def hotspot_kpis(spots: DataFrame) -> DataFrame:
    return spots.agg(
        F.count(F.lit(1)).alias("n_hotspots"), F.coalesce(F.avg("column_density"), F.lit(0.0)).alias("mean_density"),
        F.count_if(F.col("source_type") == "industrial").alias("n_industrial"),
        F.count_if(F.col("confidence") >= 0.85).alias("n_confident"))


def time_series(obs: DataFrame, station: Column | int, reference: Column, days: int = 7,
                pollutants: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Last ``days`` of one station in time order, long by pollutant when a list is given."""
    kept = obs.where((F.col("station_id") == station)
                     & (F.col(ts) > reference - F.make_interval(days=F.lit(days))) & (F.col(ts) <= reference))
    if not pollutants:
        return kept.orderBy(ts)
    keys = [c for c in kept.columns if c not in pollutants]
    return kept.unpivot(keys, list(pollutants), "pollutant", "value").orderBy(ts, "pollutant")


def monthly_trend(df: DataFrame, ts: str, value: str, region: str) -> DataFrame:
    """Monthly mean per region, and its distance from the region's mean of that calendar month.

    Sums and counts are combined per month first; the calendar-month baseline comes from those.
    """
    month = F.date_format(F.col(ts), "yyyy-MM")
    monthly = df.groupBy(region, month.alias("month")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    calendar = F.substring("month", 6, 2)
    base = monthly.groupBy(F.col(region).alias("_r"), calendar.alias("_m")).agg(
        (F.sum("_s") / F.sum("_n")).alias("_base"))
    on = F.col(region).eqNullSafe(F.col("_r")) & (calendar == F.col("_m"))
    mean = F.col("_s") / F.col("_n")
    return monthly.join(base, on).select(
        region, "month", mean.alias("mean_value"), (mean - F.col("_base")).alias("anomaly"))


def forecast(latest: DataFrame, start: Column, horizon_hours: int = 72, default_base: float = 150.0) -> DataFrame:
    """Hourly index steps per station from its latest value (``base``; unknown stations use the default).

    As many steps as the horizon has hours; the trend has no natural end.
    """
    if horizon_hours < 1:
        raise ValueError("the horizon must be at least one hour")
    rows = latest.select("station_id", F.coalesce("base", F.lit(default_base)).alias("base"),
                         F.explode(F.sequence(F.lit(1), F.lit(horizon_hours))).alias("step"))
    at = start + F.make_interval(hours=F.col("step"))
    rows = rows.withColumn("forecast_at", at)
    daily = F.lit(1.0) + F.lit(0.15) * (F.lit(1.0) - F.abs(F.hour("forecast_at") - 6) / 12.0)
    rows = rows.withColumn("predicted_aqi",
                           F.greatest(F.lit(0.0), F.bround(F.col("base") * daily - F.col("step") * 0.8, 1)))
    spread = F.lit(10.0) + F.col("step") * 0.4
    return rows.select(
        "station_id", "step", "forecast_at", "predicted_aqi",
        F.greatest(F.lit(0.0), F.bround(F.col("predicted_aqi") - spread, 1)).alias("lower_bound"),
        F.bround(F.col("predicted_aqi") + spread, 1).alias("upper_bound"),
        ax.category(F.col("predicted_aqi")).alias("category"))


def latest_values(readings: DataFrame, value: str = "aqi", ts: str = "ts") -> DataFrame:
    """Latest known value per station; the larger one when two share the latest moment."""
    known = readings.where(F.col(value).isNotNull())
    last = F.max(F.struct(F.col(ts).alias("ts"), F.col(value).cast("double").alias("v")))
    return known.groupBy("station_id").agg(last.alias("_l")).select("station_id", F.col("_l.v").alias("base"))
