"""Renaming, adding and choosing columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from aeroframe import values as V


def _rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    names = [mapping.get(c, c) for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"several input columns map to: {', '.join(doubled)}")
    return df.toDF(*names)


def rename_pollutant_columns(df: DataFrame) -> DataFrame:
    """Exact synonyms only; every other column keeps its name."""
    target = {**V.POLLUTANT_COLUMNS, "AQI": "aqi"}
    return _rename(df, {c: target[V.COLUMN_SYNONYMS[c]] for c in df.columns if c in V.COLUMN_SYNONYMS})


def rename_grid_columns(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Fold names and map them; latitude, longitude and time aliases win."""
    mapping = {}
    for c in df.columns:
        key = c.strip().casefold()
        mapping[c] = aliases.get(key.replace(" ", "_"), aliases.get(key, c))
        if key in V.GRID_LAT_ALIASES:
            mapping[c] = "latitude"
        elif key in V.GRID_LON_ALIASES:
            mapping[c] = "longitude"
        elif key in V.GRID_TIME_ALIASES:
            mapping[c] = "timestamp"
    return _rename(df, mapping)


def rename_station_columns(df: DataFrame) -> DataFrame:
    return _rename(df, {c: V.STATION_COLUMN_ALIASES.get(c.strip().casefold(), c) for c in df.columns})


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in order; absent ones and values that cannot be cast are null."""
    present = set(df.columns)
    return df.select([
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema])


def cast_failures(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: per column of ``schema`` that is present, the values that ``ensure_columns`` makes null."""
    present = set(df.columns)
    return df.agg(*[
        F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).alias(f.name)
        for f in schema if f.name in present])


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of another table: absent ones are 0.0, extra ones are dropped."""
    present = set(df.columns)
    return df.select([F.col(c) if c in present else F.lit(0.0).alias(c) for c in columns])


def attach_units(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_unit": F.lit(u) for c, u in V.UNITS.items() if c in df.columns})


def groups() -> list[str]:
    return sorted({group for _, _, group, *_ in V.FEATURES})


def features_in_group(group: str) -> list[str]:
    return [column for column, _, g, *_ in V.FEATURES if g == group.upper()]


def group_of(column: str) -> str | None:
    return next((g for c, _, g, *_ in V.FEATURES if c == column), None)


def select_by_group(df: DataFrame, wanted: Iterable[str], metadata: bool = True, targets: bool = True) -> DataFrame:
    names = [c for g in wanted for c in features_in_group(g)]
    names += features_in_group("METADATA") if metadata else []
    names += features_in_group("TARGET") if targets else []
    return df.select([c for c in dict.fromkeys(names) if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def target_column(df: DataFrame, configured: str = "aqi") -> str:
    """Configured target, else pm25, else the last numeric column."""
    numeric = numeric_columns(df)
    for name in (configured, "pm25"):
        if name in df.columns:
            return name
    if numeric:
        return numeric[-1]
    raise ValueError("no target column")


def split_features(df: DataFrame, target: str, numeric_only: bool = False) -> tuple[list[str], str]:
    """Feature names and target name; frames stay whole (assemblers pick columns)."""
    pool = numeric_columns(df) if numeric_only else df.columns
    if target not in df.columns:
        raise ValueError(f"target column {target} is absent")
    return [c for c in pool if c != target], target
