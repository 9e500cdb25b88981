"""Streaming cleaning and the hourly fire timeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from aeroframe.operators.clean import is_outlier, outlier_fences
from aeroframe.operators.columns import attach_units
from aeroframe.operators.filters import drop_negative_rows
from aeroframe.operators.sizes import attach_row


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def collect_fences(table: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Outlier fences of a finished table, ready for the streaming form (an action: one row)."""
    row = outlier_fences(table, columns).collect()[0]
    return {c: (row[f"{c}_low"], row[f"{c}_high"]) for c in columns}


def clean_stream(stream: DataFrame, station: str, ts: str, columns: Sequence[str],
                 fences: dict[str, tuple[float | None, float | None]] | None, delay: str) -> DataFrame:
    """Keyed de-duplication inside the watermark, negatives out, outliers flagged, units attached.

    Outlier fences come from a finished table: quantiles cannot be kept incrementally. Rows later than
    ``delay`` are dropped; ``Finished.dropped`` counts them.
    """
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([station, ts])
    kept = drop_negative_rows(once, columns)
    flags = {}
    for c, (low, high) in (fences or {}).items():
        bounds = F.struct(F.lit(low).cast("double").alias(f"{c}_low"), F.lit(high).cast("double").alias(f"{c}_high"))
        flags[f"{c}_outlier"] = is_outlier(c, bounds)
    return attach_units(kept.withColumns(flags) if flags else kept)


def fire_timeline_stream(fires: DataFrame, ts: str = "detected_at") -> DataFrame:
    """Fires and their power per hour, as running totals: to be run in update mode.

    No watermark: an hour is never closed, so no fire comes too late. The state is one row per hour.
    ``run_available_closing`` closes hours and lists late fires.
    """
    hours = fires.where(F.col(ts).isNotNull()).groupBy(F.window(ts, "1 hour")).agg(
        F.count("frp").alias("n_fires"), F.sum("frp").alias("total_frp"))
    return hours.select(F.col("window.start").alias("hour_ts"), "n_fires", "total_frp")


@dataclass(frozen=True)
class Finished:
    """Result table of a finished run and how many rows its watermark dropped."""

    table: DataFrame
    dropped: int


def _dropped(query: StreamingQuery) -> int:
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def run_available(stream: DataFrame, folder: str) -> Finished:
    """Process everything available, then stop; appended rows are a table in ``folder``, which the caller owns."""
    query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", f"{folder}/state").start(f"{folder}/table"))
    query.awaitTermination()
    return Finished(stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table"), _dropped(query))


def run_available_keyed(stream: DataFrame, keys: Sequence[str], folder: str) -> Finished:
    """The same for running totals: each batch writes the keys it touched, the newest batch of a key counts.

    A batch that is tried again writes the same folder again, so nothing counts twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    query = (stream.writeStream.outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", f"{folder}/state").foreachBatch(write).start())
    query.awaitTermination()
    spark, schema = stream.sparkSession, T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).option("basePath", f"{folder}/table").parquet(f"{folder}/table")
    values = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return Finished(newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values]), _dropped(query))


_HOURS = T.StructType([
    T.StructField("hour_ts", T.TimestampType()), T.StructField("late", T.BooleanType()), T.StructField("n_fires", T.LongType()),
    T.StructField("total_frp", T.DoubleType()), T.StructField("latest", T.TimestampType()), T.StructField("batch", T.LongType())])


def _read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


@dataclass(frozen=True)
class ClosingTimeline:
    """A timeline with closing hours: ``hours`` (hour_ts, n_fires, total_frp, closed) and ``late``, the fires left out.

    ``late`` has the columns of the stream and ``batch``, the number of the batch that brought the fire. Every fire with
    a time is either counted in its hour or listed as late.
    """

    hours: DataFrame
    late: DataFrame


def run_available_closing(fires: DataFrame, folder: str, delay: str, ts: str = "detected_at") -> ClosingTimeline:
    """Process everything available of a stream of fires; hours close ``delay`` after their end, later fires are set aside.

    The watermark of a batch is the latest time of all batches before it, less ``delay``. A fire whose hour ended at or
    before it is late: its hour is closed and does not change any more. That is the rule of an appending aggregation
    behind ``withWatermark``, which drops such rows without listing them.

    A batch writes one row per hour it touched, and its late fires. A batch that is tried again writes the same folders again,
    so nothing counts twice; a later call with the same ``folder`` goes on where this one ended. Fires without a time
    count nowhere; a null power counts in no sum, as in the batch form.
    """
    spark, schema = fires.sparkSession, fires.schema
    parts, aside = f"{folder}/hours", f"{folder}/late"
    wait = F.expr(f"INTERVAL {delay}")
    hour = F.date_trunc("hour", F.col(ts))
    mark_of = lambda table: table.agg((F.max("latest") - wait).alias("mark"))

    listed = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    for place, columns in ((parts, _HOURS), (aside, listed)):      # an empty batch, so that a stream without files has results
        spark.createDataFrame([], T.StructType(columns.fields[:-1])).write.mode("ignore").parquet(f"{place}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        earlier = _read_batches(spark, parts, _HOURS).where(F.col("batch") < number)
        mark = mark_of(earlier).select(F.unix_micros("mark")).first()[0]      # one value
        late = F.coalesce(hour + F.expr("INTERVAL 1 HOUR") <= F.timestamp_micros(F.lit(mark).cast("long")), F.lit(False))
        timed = batch.where(F.col(ts).isNotNull())
        timed.groupBy(hour.alias("hour_ts"), late.alias("late")).agg(
            F.count("frp").alias("n_fires"), F.sum(F.col("frp").cast("double")).alias("total_frp"), F.max(ts).alias("latest"),
        ).write.mode("overwrite").parquet(f"{parts}/batch={number}")
        timed.where(late).write.mode("overwrite").parquet(f"{aside}/batch={number}")

    query = (fires.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start())
    query.awaitTermination()
    written = _read_batches(spark, parts, _HOURS)
    totals = written.where(~F.col("late")).groupBy("hour_ts").agg(F.sum("n_fires").alias("n_fires"), F.sum("total_frp").alias("total_frp"))
    closed = F.col("hour_ts") + F.expr("INTERVAL 1 HOUR") <= F.col("_mark.mark")
    hours = attach_row(totals, mark_of(written), "_mark").select("hour_ts", "n_fires", "total_frp", closed.alias("closed"))
    return ClosingTimeline(hours, _read_batches(spark, aside, listed))
