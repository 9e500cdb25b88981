"""Cleaning of wide observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aeroframe import values as V
from aeroframe.operators.dedup import distinct_rows, mark_first
from aeroframe.operators.filters import any_negative, invalid_coordinates
from aeroframe.operators.orderstat import exact_quantiles, wide_quantiles
from aeroframe.operators.sizes import attach_row


def pivot_first(long: DataFrame, keys: Sequence[str], pollutants: dict[str, str], pollutant: str = "pollutant",
                value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """Long to wide with the first non-null value in input order; rows with a null key vanish.

    A fixed column list and one conditional minimum per pollutant: a single map-side combined
    aggregation, without the extra job that discovers pivot values.
    """
    canonical = F.when(F.col(pollutant) == "OZONE", "O3").otherwise(F.col(pollutant))
    known = F.col(value).isNotNull() & ~F.isnan(value)
    cells = []
    for name, column in pollutants.items():
        hit = (canonical == name) & known
        cells.append(F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col(ordinal))).alias(column))
    return long.dropna(subset=list(keys)).groupBy(*keys).agg(*cells)


def outlier_fences(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: lower and upper IQR fence per column; null when the spread is zero or unknown."""
    quartiles = wide_quantiles(exact_quantiles(df, columns, [0.25, 0.75]), columns, {0.25: "q1", 0.75: "q3"})
    out = []
    for c in columns:
        q1, q3 = F.col(f"{c}_q1"), F.col(f"{c}_q3")
        spread = F.when(q3 - q1 != 0, q3 - q1)
        out += [(q1 - 1.5 * spread).alias(f"{c}_low"), (q3 + 1.5 * spread).alias(f"{c}_high")]
    return quartiles.select(*out)


def is_outlier(column: str, fences: Column) -> Column:
    x = F.col(column).cast("double")
    off = (x < fences.getField(f"{column}_low")) | (x > fences.getField(f"{column}_high"))
    return F.coalesce(off, F.lit(False))


def flag_outliers(df: DataFrame, columns: Sequence[str], fences: DataFrame | None = None) -> DataFrame:
    """Add ``<column>_outlier``. Pass ``fences`` to judge against a table computed elsewhere."""
    held = attach_row(df, outlier_fences(df, columns) if fences is None else fences, "_fences")
    return held.withColumns({f"{c}_outlier": is_outlier(c, F.col("_fences")) for c in columns}).drop("_fences")


def cleaning_flags(df: DataFrame, station: str, ts: str, columns: Sequence[str], ordinal: str) -> DataFrame:
    """Distinct rows with ``copies``, ``is_first`` (per station and time) and ``is_negative``."""
    once = distinct_rows(df, ordinal, copies="copies")
    return mark_first(once, [station, ts], ordinal, "is_first").withColumn("is_negative", any_negative(once, columns))


def cleaning_metrics(df: DataFrame, station: str, ts: str, columns: Sequence[str], ordinal: str,
                     lat: str | None = None, lon: str | None = None) -> DataFrame:
    """One row with the counts of every cleaning step, in the order the steps run."""
    content = [c for c in df.columns if c != ordinal]
    flags = cleaning_flags(df, station, ts, columns, ordinal)
    kept = F.col("is_first") & ~F.col("is_negative")
    flags = attach_row(flags, outlier_fences(flags.where(kept), columns), "_fences")
    nulls = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in content)
    outliers = sum(F.when(is_outlier(c, F.col("_fences")), 1).otherwise(0) for c in columns)
    off = invalid_coordinates(F.col(lat), F.col(lon)) if lat and lon else F.lit(False)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return flags.agg(
        total(F.col("copies")).alias("rows_before"),
        F.count_if(kept).alias("rows_after"),
        total(nulls * F.col("copies")).alias("missing_values"),
        total(F.col("copies") - 1).alias("duplicates_removed"),
        F.count_if(~F.col("is_first")).alias("duplicate_timestamps_removed"),
        F.count_if(F.col("is_first") & F.col("is_negative")).alias("negative_pollutant_values"),
        total(F.when(kept, outliers)).alias("outlier_count"),
        F.count_if(kept & off).alias("invalid_coordinates"))


def quality_report(metrics: DataFrame, dataset: str, source_file: str, mismatches: Column | None = None,
                   stamp: Column | None = None, warnings: Sequence[str] = (), errors: Sequence[str] = ()) -> DataFrame:
    """One row per dataset with the 14 columns of the report."""
    return metrics.select(
        F.lit(dataset).alias("dataset"), F.lit(source_file).alias("source_file"),
        "rows_before", "rows_after", "missing_values", "duplicates_removed", "duplicate_timestamps_removed",
        "negative_pollutant_values", "outlier_count", "invalid_coordinates",
        (F.lit(0).cast("long") if mismatches is None else mismatches).alias("station_metadata_mismatches"),
        (F.current_timestamp() if stamp is None else stamp).alias("cleaning_timestamp"),
        F.concat_ws("; ", F.array(*[F.lit(w) for w in warnings]).cast("array<string>")).alias("warnings"),
        F.concat_ws("; ", F.array(*[F.lit(e) for e in errors]).cast("array<string>")).alias("errors"))
