"""Row numbers over a whole table, spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from aeroframe.session import cut_lineage


def materialise_ordinal(df: DataFrame, keys: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Zero-based position in the order of ``keys`` (an action: it checkpoints).

    Range partitioning spreads the sort; the checkpoint pins which rows each partition holds, since
    range bounds are sampled and a second evaluation could move rows. Keys should end in a unique one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    pinned = cut_lineage(spread.withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))

    # one row per partition: bounded by the partition count
    sizes = pinned.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (pinned.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, place + F.col("_offset"))
            .drop("_m", "_part", "_offset"))
