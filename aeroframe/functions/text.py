"""Text normalisation used when comparing registries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def folded(x: Column) -> Column:
    """Null becomes empty; trimmed and in lower case."""
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))
