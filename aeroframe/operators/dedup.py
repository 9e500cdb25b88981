"""Exact and keyed de-duplication that follows input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def distinct_rows(df: DataFrame, ordinal: str, copies: str | None = None) -> DataFrame:
    """One row per distinct content, with the first ordinal; nulls are equal.

    A grouped minimum, so copies are combined on the map side.
    """
    content = [c for c in df.columns if c != ordinal]
    extra = [F.count(F.lit(1)).alias(copies)] if copies else []
    return df.groupBy(*content).agg(F.min(ordinal).alias(ordinal), *extra)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key. The rank filter is pushed below the shuffle, one row per key and task."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def mark_first(df: DataFrame, keys: Sequence[str], ordinal: str, name: str,
               where: Column | None = None) -> DataFrame:
    """Add boolean ``name``: the row is the first of its key among the rows that satisfy ``where``.

    First ordinals come from a map-side combined minimum, and rows are looked up by their own
    (unique) ordinal, so a key that holds most rows never meets in one task.
    """
    pool = df.where(where) if where is not None else df
    firsts = pool.groupBy(*keys).agg(F.min(ordinal).alias(ordinal)).select(ordinal, F.lit(True).alias(name))
    return df.join(firsts, ordinal, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def duplicate_key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
