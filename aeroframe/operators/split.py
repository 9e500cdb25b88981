"""Train, validation and test labels with exact sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroframe import values as V
from aeroframe.operators.orderstat import order_statistics, time_levels
from aeroframe.operators.sizes import attach_row


def _label(df: DataFrame, key: Sequence[Column], cuts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows before the first cut get the first name, and so on. Cuts are scalar subqueries."""
    one = cuts.agg(*[
        F.max(F.when(F.col("rank_name") == str(i), F.col("_cut"))).alias(f"c{i}") for i in range(len(names) - 1)
    ])
    held = attach_row(df, one, "_cuts")
    chain = None
    for i, name in enumerate(names[:-1]):
        cut = F.col(f"_cuts.c{i}")
        fields = [cut.getField(f"k{j}") for j in range(len(key))]
        before = key[-1] < fields[-1]
        for k, f in list(zip(key, fields))[-2::-1]:
            before = (k < f) | ((k == f) & before)
        # a cut past the last row does not exist: everything lies before it
        hit = cut.isNull() | before
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return held.withColumn("split", chain.otherwise(names[-1])).drop("_cuts")


def chronological_split(
    df: DataFrame, ts: str, ordinal: str,
    ratios: Sequence[float] = V.SPLIT_RATIOS, names: Sequence[str] = ("train", "validation", "test"),
) -> DataFrame:
    """Add ``split``: the first int(n*r0) rows in time order, the next int(n*r1), the rest.

    Only the keys of the cut rows are searched for; the table itself is labelled by a comparison,
    without a shuffle.
    """
    if len(ratios) != len(names) or abs(sum(ratios) - 1.0) > 0.01:
        raise ValueError("ratios must match the names and sum to 1")
    base, levels = time_levels(df, ts, ordinal)
    ranks = {}
    for i in range(len(ratios) - 1):
        ranks[str(i)] = lambda n, i=i: sum(F.floor(n * F.lit(float(r))) for r in ratios[:i + 1])
    found = order_statistics(base, [], levels, ranks)
    cuts = found.select("rank_name", F.struct(F.col("_ts").alias("k0"), F.col("_id").alias("k1")).alias("_cut"))
    moment = F.coalesce(F.col(ts).cast("timestamp"), F.lit("9999-12-31 00:00:00").cast("timestamp"))
    return _label(df, [moment, F.col(ordinal).cast("long")], cuts, names)


def holdout_split(df: DataFrame, ts: str, ordinal: str, ratio: float = 0.7) -> DataFrame:
    return chronological_split(df, ts, ordinal, (ratio, 1 - ratio), ("train", "test"))


def random_split(df: DataFrame, ordinal: str, ratio: float = 0.7, seed: int = V.SEED) -> DataFrame:
    """Seeded split with exact sizes: the first int(n*ratio) rows by hash of the row id."""
    hashed = F.xxhash64(F.col(ordinal), F.lit(seed))
    base = df.select(F.shiftright(hashed, 44).alias("_page"), hashed.alias("_hash"), F.col(ordinal).alias("_id"))
    found = order_statistics(base, [], ["_page", "_hash", "_id"], {"0": lambda n: F.floor(n * F.lit(ratio))})
    cuts = found.select("rank_name", F.struct(F.col("_hash").alias("k0"), F.col("_id").alias("k1")).alias("_cut"))
    return _label(df, [hashed, F.col(ordinal)], cuts, ("train", "test"))


def split_summary(labelled: DataFrame) -> DataFrame:
    """Rows and actual ratio per split."""
    counts = labelled.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))      # three rows
    return counts.select("split", "n_rows", (F.col("n_rows") / total).alias("ratio"))
