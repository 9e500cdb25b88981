"""Single rows as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the single row of ``one_row`` as struct column ``name``.

    An uncorrelated scalar subquery: it is planned and run once, and no join is involved.
    """
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())
