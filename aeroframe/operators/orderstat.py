"""Exact order statistics without a global sort.

The wanted row is found digit by digit: count rows per coarse bucket of the sort key, pick the
bucket that holds the rank, then count inside that bucket only. Every step is a map-side combined
count, so only counters are shuffled, whatever the row count and however rows pile up on one key.
Numbers are bucketed by magnitude first; the values of the bucket picked are then parted in even steps of
its own range and ranked inside one part: a column with a large offset and a small spread is cut as finely
as any other, and no task ranks more than about a 2^-16th part of an even spread.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_STEPS_PER_OCTAVE = 4096
EVEN_STEPS = 1 << 16
_LAST = "9999-12-31 00:00:00"


def order_statistics(
    base: DataFrame,
    group: Sequence[str],
    levels: Sequence[str],
    ranks: dict[str, Callable[[Column], Column]],
    weight: str | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Keys at the given zero-based ranks of the order (levels[0], levels[1], ...).

    ``levels`` are columns of ``base``, coarse to exact; ``ranks`` maps a name to a function from the
    group's row count to the rank. ``bounded`` says that groups times ranks is a fixed small number,
    which makes the path tables safe to broadcast. One row per group and rank that exists, with the
    group's row count ``n``. Each level reads ``base`` once more, narrowed by the level before.
    """
    group, levels = list(group), list(levels)
    tally = F.sum(weight) if weight else F.count(F.lit(1))
    path, known = None, []
    for level in levels:
        if path is None:
            keys, counted = group, base.groupBy(*group, level).agg(tally.alias("_c"))
        else:
            keys = [*group, *known, "rank_name", "_r", "n"]
            on = [*group, *known]
            inside = base.join(F.broadcast(path) if bounded else path, on)
            counted = inside.groupBy(*keys, level).agg(tally.alias("_c"))
        parts = keys or [F.lit(0)]
        running = Window.partitionBy(*parts).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        spans = counted.withColumn("_end", F.sum("_c").over(running)).withColumn("_start", F.col("_end") - F.col("_c"))
        if path is None:
            spans = spans.withColumn("n", F.sum("_c").over(Window.partitionBy(*parts)))
            wanted = F.array(*[
                F.struct(F.lit(name).alias("rank_name"), rank(F.col("n")).cast("long").alias("_r"))
                for name, rank in ranks.items()])
            here = F.filter(wanted, lambda w: (w["_r"] >= F.col("_start")) & (w["_r"] < F.col("_end")))
            hits = spans.withColumn("_w", F.explode(here)).withColumns(
                {"rank_name": F.col("_w.rank_name"), "_r": F.col("_w._r")})
        else:
            hits = spans.where((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_end")))
        known.append(level)
        path = hits.select(*group, *known, "rank_name", (F.col("_r") - F.col("_start")).alias("_r"), "n")
    return path.select(*group, "rank_name", *levels, "n")


def magnitude_bucket(x: Column) -> Column:
    """Order-preserving coarse bucket of a number: sign and a fine logarithm."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1025.0)) * _STEPS_PER_OCTAVE) + 1080 * _STEPS_PER_OCTAVE
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.signum(x).cast("long") * size.cast("long"))


def value_statistics(
    long: DataFrame, group: Sequence[str], ranks: dict[str, Callable[[Column], Column]], weight: str | None = None,
    bounded: bool = True,
) -> DataFrame:
    """(group..., rank_name, value, n): the values at zero-based ranks of the column ``value`` of each group.

    A bucket is remembered by its least and largest value; buckets do not overlap, so the rows between the
    two are the bucket. ``bounded`` as in ``order_statistics``; ``group`` must not be empty or hold nulls.
    """
    group = list(group)
    tally = F.sum(weight) if weight else F.count(F.lit(1))
    ends = [F.min("value").alias("_lo"), F.max("value").alias("_hi")]

    def spans(counted: DataFrame, keys: list[str], level: str) -> DataFrame:
        running = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counted.withColumn("_end", F.sum("_c").over(running)).withColumn("_start", F.col("_end") - F.col("_c"))

    counted = long.groupBy(*group, magnitude_bucket(F.col("value")).alias("_bucket")).agg(tally.alias("_c"), *ends)
    first = spans(counted, group, "_bucket").withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    wanted = F.array(*[F.struct(F.lit(name).alias("rank_name"), rank(F.col("n")).cast("long").alias("_r")) for name, rank in ranks.items()])
    here = F.filter(wanted, lambda w: (w["_r"] >= F.col("_start")) & (w["_r"] < F.col("_end")))
    path = first.withColumn("_w", F.explode(here)).select(
        *group, "_w.rank_name", (F.col("_w._r") - F.col("_start")).alias("_r"), "n", "_lo", "_hi")

    # distinct values of the bucket are counted once; they are ranked inside one even part of it only
    keys = [*group, "rank_name", "_r", "n"]
    even = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * EVEN_STEPS)).otherwise(0)
    inside = long.join(F.broadcast(path) if bounded else path, group).where(F.col("value").between(F.col("_lo"), F.col("_hi")))
    values = inside.groupBy(*keys, even.alias("_even"), "value").agg(tally.alias("_c"))
    hit = (F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_end"))
    parts = spans(values.groupBy(*keys, "_even").agg(F.sum("_c").alias("_c")), keys, "_even").where(hit)
    parts = parts.select(*keys, "_even", F.col("_start").alias("_before"))
    picked = values.join(F.broadcast(parts) if bounded else parts, [*keys, "_even"])
    ranked = spans(picked, [*keys, "_even"], "value").where(
        (F.col("_r") >= F.col("_before") + F.col("_start")) & (F.col("_r") < F.col("_before") + F.col("_end")))
    return ranked.select(*group, "rank_name", "value", "n")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles as rows (by..., column_name, probability, value).

    Without ``by``: narrow scans, one per level. With ``by``: values are first counted per group and
    distinct value, so a hot group reaches the shuffle as counters.
    """
    by = list(by)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(*by, pairs.alias("_p")).select(*by, "_p.column_name", "_p.value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    weight = None
    if by:
        long = long.groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("_w"))
        weight = "_w"

    ranks: dict[str, Callable[[Column], Column]] = {}
    for p in probabilities:
        ranks[f"{p}|lo"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1))
        ranks[f"{p}|hi"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    found = value_statistics(long, [*by, "column_name"], ranks, weight, bounded=not by)

    named = found.select(
        *by, "column_name", "value", "n",
        F.split("rank_name", "[|]").getItem(0).cast("double").alias("probability"),
        F.split("rank_name", "[|]").getItem(1).alias("_side"),
    )
    ends = named.groupBy(*by, "column_name", "probability").agg(
        F.max(F.when(F.col("_side") == "lo", F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("_side") == "hi", F.col("value"))).alias("_hi"), F.max("n").alias("n"))
    position = F.col("probability") * (F.col("n") - 1)
    return ends.select(
        *by, "column_name", "probability",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (position - F.floor(position))).alias("value"))


def wide_quantiles(quantiles: DataFrame, columns: Sequence[str], names: dict[float, str],
                   by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with ``<column>_<name>`` for every column and probability."""
    cells = [
        F.max(F.when((F.col("column_name") == c) & (F.col("probability") == F.lit(p)), F.col("value")))
        .alias(f"{c}_{name}")
        for c in columns for p, name in names.items()
    ]
    return quantiles.groupBy(*by).agg(*cells)


def time_levels(df: DataFrame, ts: str, ordinal: str) -> tuple[DataFrame, list[str]]:
    """Level columns for the order (ts, ordinal); rows without a time sort last."""
    moment = F.coalesce(F.col(ts).cast("timestamp"), F.lit(_LAST).cast("timestamp"))
    levelled = df.select(
        F.date_trunc("hour", moment).alias("_hour"), moment.alias("_ts"),
        F.shiftright(F.col(ordinal).cast("long"), 20).alias("_page"), F.col(ordinal).cast("long").alias("_id"))
    return levelled, ["_hour", "_ts", "_page", "_id"]


def upper_median_time(df: DataFrame, ts: str) -> DataFrame:
    """One row ``median_ts``: the element at floor(n/2) of the sorted times."""
    base = df.where(F.col(ts).isNotNull()).select(
        F.date_trunc("hour", F.col(ts)).alias("_hour"), F.col(ts).alias("_ts"))
    found = order_statistics(base, [], ["_hour", "_ts"], {"median": lambda n: F.floor(n / 2)})
    return found.select(F.col("_ts").alias("median_ts"))
