"""Reading CSV, JSON and gridded arrays with fixed schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, numeric: Sequence[str] = ()) -> DataFrame:
    """Headered CSV under a fixed schema; ``numeric`` columns are read as text and cast softly."""
    fields = [T.StructField(f.name, T.StringType() if f.name in numeric else f.dataType) for f in schema]
    raw = spark.read.csv(path, header=True, schema=T.StructType(fields), mode="PERMISSIVE")
    return raw.select([F.col(f.name).try_cast("double").alias(f.name) if f.name in numeric else F.col(f.name)
                       for f in schema])


def newest_snapshot(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Newest file or folder directly below ``folder`` that matches the pattern; None when nothing matches.

    A folder is as new as the newest file anywhere below it; the greatest name wins a tie. An action over
    the file listing only: the content column is never read.
    """
    if not _matches(spark, f"{folder}/{pattern}"):
        return None
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{pattern}")
    # paths come back qualified: the snapshot is the component behind the folder's own last one
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_extract("path", f"^(.*?/{re.escape(root)}/[^/]+)", 1)
    depth = F.substring_index(name, "/", -1)
    found = listing.select(name.alias("snapshot"), depth.alias("name"), "modificationTime").where(F.col("name") != "")
    top = found.agg(F.max(F.struct("modificationTime", "name")).alias("m")).select("m.name").collect()
    return None if top[0][0] is None else f"{folder.rstrip('/')}/{top[0][0]}"


def _matches(spark: SparkSession, glob: str) -> bool:
    """Whether any path matches; permission and other errors are raised, not taken for absence."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def first_existing(spark: SparkSession, folder: str, names: Sequence[str]) -> str | None:
    """Path of the first candidate that exists, else None (an action per candidate, listing only)."""
    for name in names:
        if newest_snapshot(spark, folder, name) is not None:
            return f"{folder}/{name}"
    return None


def read_latest(spark: SparkSession, folder: str, pattern: str, schema: T.StructType,
                numeric: Sequence[str] = ()) -> DataFrame | None:
    """Only the newest snapshot is read; None when there is none."""
    path = newest_snapshot(spark, folder, pattern)
    return None if path is None else read_csv(spark, path, schema, numeric)


class Pages(NamedTuple):
    """Records of all readable pages; every page with its state, announced total and records found."""

    records: DataFrame
    pages: DataFrame


def read_pages(spark: SparkSession, path: str, record: T.StructType, one_per_file: bool = True) -> Pages:
    """Read pages of the form ``{records: [...], total}``.

    A page is ``unreadable`` (no list of records), ``incomplete`` (fewer records than its total) or ``complete``.
    """
    schema = T.StructType([
        T.StructField("records", T.ArrayType(record)), T.StructField("total", T.LongType()),
        T.StructField(CORRUPT, T.StringType())])
    pages = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=one_per_file)
    tagged = pages.withColumn("page", F.input_file_name())
    records = tagged.where(F.col("records").isNotNull()).select("page", F.explode("records").alias("r")).select("page", "r.*")
    found = F.coalesce(F.when(F.col("records").isNotNull(), F.size("records")), F.lit(0)).cast("long")
    state = (F.when(F.col("records").isNull(), "unreadable").when(found < F.col("total"), "incomplete").otherwise("complete"))
    return Pages(records, tagged.select("page", state.alias("state"), "total", found.alias("n_records"), CORRUPT))


MEASUREMENT = T.StructType([
    T.StructField("locationId", T.LongType()), T.StructField("location", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("parameter", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("coordinates", T.StructType([T.StructField("latitude", T.DoubleType()),
                                               T.StructField("longitude", T.DoubleType())])),
    T.StructField("date", T.StructType([T.StructField("utc", T.StringType()), T.StructField("local", T.StringType())])),
])


def flatten_measurements(records: DataFrame) -> DataFrame:
    """Nested measurement records to flat rows; rows without place, parameter or value are dropped."""
    return records.dropna(subset=["location", "parameter", "value"]).select(
        F.col("locationId").alias("location_id"), "location", "country", "city", "parameter", "value", "unit",
        F.col("coordinates.latitude").alias("latitude"), F.col("coordinates.longitude").alias("longitude"),
        F.col("date.utc").alias("utc_time"), F.col("date.local").alias("local_time"))


def flatten_grid(cubes: DataFrame, variables: dict[str, str], times: str = "times", lats: str = "lats",
                 lons: str = "lons") -> DataFrame:
    """Rows holding axis arrays and flat value arrays to one row per (time, lat, lon).

    ``variables`` maps the array column to the output name. The flat position drives everything, so
    one generator expands a cube; a cube may be split over many rows by time slices at ingest.
    """
    n_lat, n_lon = F.size(lats), F.size(lons)
    total = F.size(times) * n_lat * n_lon
    positions = cubes.where(total > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), total - 1)))
    at = lambda axis, index: F.element_at(axis, (index + 1).cast("int"))
    return positions.select(
        at(times, F.floor(F.col("_i") / (n_lat * n_lon))).alias("timestamp"),
        at(lats, F.floor(F.col("_i") / n_lon) % n_lat).alias("latitude"),
        at(lons, F.col("_i") % n_lon).alias("longitude"),
        *[F.try_element_at(F.col(c), F.col("_i") + 1).alias(name) for c, name in variables.items()])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one thing in the data model; run once per reader."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return df.select([clean(c) if c in floats else F.col(c) for c in df.columns])
