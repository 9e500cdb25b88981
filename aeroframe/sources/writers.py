"""Writing tables, manifests and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

MANIFEST_SCHEMA = "dataset string, url string, written_at timestamp, n_rows long, status string"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> int:
    """Write Parquet and return the row count, observed during the write itself."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = observed.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return int(seen.get["n"])


def append_manifest(spark, path: str, dataset: str, url: str, n_rows: int, status: str) -> None:
    """Add one row to the manifest table."""
    row = spark.range(1).select(
        F.lit(dataset).alias("dataset"), F.lit(url).alias("url"), F.current_timestamp().alias("written_at"),
        F.lit(n_rows).cast("long").alias("n_rows"), F.lit(status).alias("status"))
    row.coalesce(1).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_splits(labelled: DataFrame, path: str) -> int:
    """Train, validation and test as partitions of one table."""
    return write_table(labelled, path, ["split"])


def write_predictions(scored: DataFrame, path: str) -> int:
    named = scored.withColumnRenamed("prediction", "predicted_target") if "prediction" in scored.columns else scored
    return write_table(named, path)


def save_model(model, path: str, metrics: DataFrame | None = None, importances: DataFrame | None = None,
               checks: DataFrame | None = None) -> None:
    """Fitted model directory with its metric tables next to it."""
    model.write().overwrite().save(f"{path}/model")
    for name, table in (("metrics", metrics), ("importances", importances), ("checks", checks)):
        if table is not None:
            table.write.mode("overwrite").json(f"{path}/{name}")


