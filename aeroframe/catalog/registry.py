"""Where queries and their DuckDB counterparts are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeroframe.catalog.inputs import Inputs, oracle_text
from aeroframe.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs)`` under ``name``; ``oracle`` may name tables and shapes in braces."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Inputs(apply_settings(spark), folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return wrap


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded output value without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def sql_r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + CAST(0 AS DOUBLE))"
