"""Missing-value strategies per station, in (time, ordinal) order.

A station's series is cut into time chunks, its rows without a time into pages of ordinals, and so are the rows
without a station, which belong to no series and keep their values. Windows run
inside a chunk; what a chunk needs from its neighbours (last and next known value, row counts) comes from
a summary with one row per chunk. A station that holds most rows is thus spread over as many tasks as it
has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroframe import values as V
from aeroframe.operators.orderstat import exact_quantiles, wide_quantiles
from aeroframe.operators.sizes import attach_row


_PAGE_BITS = 16                      # rows without a time: ordinals per page


def _chunked(df: DataFrame, station: str, ts: str, chunk: str, ordinal: str) -> DataFrame:
    """Add ``_chunk``, which sorts by time, rows without a time last."""
    untimed = F.col(ts).isNull() | F.col(station).isNull()
    page = F.when(untimed, F.shiftright(F.col(ordinal).cast("long"), _PAGE_BITS))
    return df.withColumn("_chunk", F.struct(
        untimed.alias("untimed"), F.when(~untimed, F.date_trunc(chunk, F.col(ts))).alias("begin"), page.alias("page")))


def _of_station(station: str, filled: Column, c: str) -> Column:
    """The filled value for rows that have a station, the column's own for others."""
    return F.when(F.col(station).isNotNull(), filled).otherwise(F.col(c))


def _with_positions(df: DataFrame, station: str, ts: str, ordinal: str) -> DataFrame:
    order = Window.partitionBy(station, "_chunk").orderBy(F.col(ts).asc_nulls_last(), ordinal)
    return df.withColumn("_pos", F.row_number().over(order))


def _carries(placed: DataFrame, station: str, columns: Sequence[str], both: bool) -> DataFrame:
    """Per chunk: rows before it, last known (position, value) before it, next known after it."""
    known = {c: F.col(c).isNotNull() for c in columns}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        at = F.when(known[c], F.col("_pos"))
        aggs += [F.max(at).alias(f"_lp_{c}"), F.max_by(F.when(known[c], F.col(c)), at).alias(f"_lv_{c}")]
        if both:
            aggs += [F.min(at).alias(f"_fp_{c}"), F.min_by(F.when(known[c], F.col(c)), at).alias(f"_fv_{c}")]
    chunks = placed.groupBy(station, "_chunk").agg(*aggs)

    order = Window.partitionBy(station).orderBy("_chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    out = [F.col(station), F.col("_chunk"), F.col("_base")]
    for c in columns:
        seen = F.col(f"_lp_{c}").isNotNull()
        prev = F.last(F.when(seen, F.struct((F.col(f"_lp_{c}") + F.col("_base")).alias("p"),
                                            F.col(f"_lv_{c}").alias("v"))), ignorenulls=True).over(before)
        out.append(prev.alias(f"_prev_{c}"))
        if both:
            nxt = F.first(F.when(seen, F.struct((F.col(f"_fp_{c}") + F.col("_base")).alias("p"),
                                                F.col(f"_fv_{c}").alias("v"))), ignorenulls=True).over(after)
            out.append(nxt.alias(f"_next_{c}"))
    return chunks.select(*out)


def _rejoin(placed: DataFrame, carries: DataFrame, station: str) -> DataFrame:
    right = carries.withColumnsRenamed({station: "_s", "_chunk": "_k"})
    on = F.col(station).eqNullSafe(F.col("_s")) & F.col("_chunk").eqNullSafe(F.col("_k"))
    return placed.join(right, on, "left").drop("_s", "_k")


def forward_fill(df: DataFrame, columns: Sequence[str], station: str = "station_id", ts: str = "ts",
                 ordinal: str = "ordinal", chunk: str = "day") -> DataFrame:
    """Last known value of the station; leading nulls stay, and so do rows without a station."""
    placed = _with_positions(_chunked(df, station, ts, chunk, ordinal), station, ts, ordinal)
    narrow = placed.select(station, "_chunk", "_pos", *columns)
    joined = _rejoin(placed, _carries(narrow, station, columns, both=False), station)
    upto = Window.partitionBy(station, "_chunk").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    filled = {c: _of_station(station, F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_prev_{c}.v")), c) for c in columns}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, columns: Sequence[str], station: str = "station_id", ts: str = "ts",
                ordinal: str = "ordinal", chunk: str = "day") -> DataFrame:
    """Linear by row position within the station; the edges take the nearest known value.

    Rows without a station stay as they are.
    """
    placed = _with_positions(_chunked(df, station, ts, chunk, ordinal), station, ts, ordinal)
    narrow = placed.select(station, "_chunk", "_pos", *columns)
    joined = _rejoin(placed, _carries(narrow, station, columns, both=True), station)
    joined = joined.withColumn("_at", F.col("_pos") + F.col("_base"))
    order = Window.partitionBy(station, "_chunk").orderBy("_pos")
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ends = {}
    for c in columns:
        here = F.when(F.col(c).isNotNull(), F.struct(F.col("_at").cast("long").alias("p"), F.col(c).alias("v")))
        ends[f"_a_{c}"] = F.coalesce(F.last(here, ignorenulls=True).over(back), F.col(f"_prev_{c}"))
        ends[f"_b_{c}"] = F.coalesce(F.first(here, ignorenulls=True).over(ahead), F.col(f"_next_{c}"))
    bounded = joined.withColumns(ends)
    filled = {}
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        slope = (b["v"] - a["v"]) * (F.col("_at") - a["p"]) / (b["p"] - a["p"])
        between = F.when(b["p"] == a["p"], a["v"]).otherwise(a["v"] + slope)
        filled[c] = _of_station(station, F.coalesce(F.col(c), between, a["v"], b["v"]), c)
    return bounded.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def station_median(df: DataFrame, columns: Sequence[str], station: str = "station_id") -> DataFrame:
    """Null becomes the station's median; a station without values and rows without a station keep theirs."""
    known = df.where(F.col(station).isNotNull())
    medians = wide_quantiles(exact_quantiles(known, columns, [0.5], by=[station]), columns, {0.5: "median"}, [station])
    # rows without a station match nothing; a key of their own per page keeps them from meeting in one task
    lost = F.when(F.col(station).isNull(), F.pmod(F.xxhash64(*columns), F.lit(4096))).otherwise(-1)
    right = medians.withColumnRenamed(station, "_s").withColumn("_k", F.lit(-1).cast("long"))
    joined = df.withColumn("_lost", lost).join(right, F.col(station).eqNullSafe(F.col("_s")) & (F.col("_lost") == F.col("_k")), "left")
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"{c}_median")).alias(c) if c in columns else F.col(c) for c in df.columns])


def apply_strategy(df: DataFrame, strategy: str, numeric: Sequence[str], station: str = "station_id",
                   ts: str = "ts", ordinal: str = "ordinal", others: Sequence[str] = (), chunk: str = "day") -> DataFrame:
    """Fill by name of the strategy; ``chunk`` is the time unit that splits a station's series."""
    if strategy not in V.MISSING_STRATEGIES:
        raise ValueError(f"unknown missing-value strategy: {strategy}")
    if strategy == "interpolation":
        return interpolate(df, numeric, station, ts, ordinal, chunk)
    if strategy == "forward_fill":
        return forward_fill(df, [*numeric, *others], station, ts, ordinal, chunk)
    if strategy == "station_median":
        return station_median(df, numeric, station)
    return df


def mean_zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the column mean, and 0 when the column has no value at all."""
    held = attach_row(df, df.agg(*[F.avg(c).alias(c) for c in columns]), "_means")
    return held.withColumns({c: F.coalesce(F.col(c), F.col(f"_means.{c}"), F.lit(0.0)) for c in columns}).drop("_means")
