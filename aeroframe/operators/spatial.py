"""Nearest grid cell by great-circle distance.

The globe is cut into equal degree buckets, a power of two around the equator. Points look into their
own bucket and its neighbours by equi-join. A match is proven when it is nearer than anything outside
those buckets could be. For the rest, a pyramid of occupied buckets gives an upper bound of the
distance, and only buckets that can beat the bound are searched. Nothing is compared all to all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aeroframe import values as V
from aeroframe.functions.geo import haversine_km
from aeroframe.session import cut_lineage

_R = V.EARTH_RADIUS_MATCH_KM
_SLACK = 1 + 1e-9


def _safe_km(degrees: float, lat: Column) -> Column:
    """Everything outside the 3x3 buckets of this size is at least this far away."""
    if degrees >= 180:
        return F.lit(math.inf)
    side = F.lit(_R) * F.asin(F.cos(F.radians(lat)) * math.sin(math.radians(min(degrees, 90.0))))
    return F.least(F.lit(_R * math.radians(degrees)), side)


def _bucketed(df: DataFrame, around: int) -> DataFrame:
    size = 360.0 / around
    return df.withColumns({
        "_by": F.floor((F.col("latitude") + 90) / size).cast("int"),
        "_bx": (F.floor(F.pmod(F.col("longitude") + 180, F.lit(360.0)) / size) % around).cast("int"),
    })


def _shift(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _block(by: Column, bx: Column, around: Column) -> Column:
    offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return F.array_distinct(F.array(*[
        F.struct((by + dy).alias("y"), F.pmod(bx + dx, around).cast("int").alias("x")) for dy, dx in offsets]))


def nearest_cell(
    points: DataFrame, cells: DataFrame, features: Sequence[str], snapshot: str | None = None,
    tie_order: Sequence[str] = ("ordinal",), buckets_around: int = 256,
) -> DataFrame:
    """Nearest cell for every distinct point (latitude, longitude[, snapshot]) that has one.

    ``cells`` has latitude, longitude, ``features`` and the ``tie_order`` columns; with ``snapshot``
    both sides carry that column and only cells of the same snapshot count. Returns the point's keys,
    the features and ``match_distance_km``. An action: distinct points and their first matches are
    checkpointed.
    """
    if buckets_around & (buckets_around - 1):
        raise ValueError("buckets_around must be a power of two")
    snap = [snapshot] if snapshot else []
    keys = [*snap, "latitude", "longitude"]
    levels = int(math.log2(buckets_around)) + 1
    size = 360.0 / buckets_around

    valid = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    here = _bucketed(points.where(valid).select(*keys).distinct(), buckets_around)
    # copies of a cell collapse to the first one before anything is joined
    carried = [c for c in dict.fromkeys([*tie_order, *features]) if c not in keys]
    packed = F.min(F.struct(*[F.col(c) for c in carried])) if carried else F.min(F.lit(0))
    there = cells.where(valid).groupBy(*keys).agg(packed.alias("_cell"))
    there = _bucketed(there, buckets_around).withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})

    distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    order = [F.col(c) if c not in keys else F.col({"latitude": "_lat", "longitude": "_lon"}[c]) for c in tie_order]
    best = F.min(F.struct(distance.alias("d"), *[o.alias(f"t{i}") for i, o in enumerate(order)],
                          F.col("_cell").alias("cell")))

    def search(asked: DataFrame) -> DataFrame:
        """asked: keys and the bucket (_by, _bx) to look into."""
        candidates = asked.join(there.select(*snap, "_by", "_bx", "_lat", "_lon",
                                             *[F.col(f"_cell.{c}").alias(c) for c in tie_order if c not in keys], "_cell"),
                                [*snap, "_by", "_bx"])
        return candidates.groupBy(*keys).agg(best.alias("_best"))

    near = here.withColumn("_n", F.explode(_block(F.col("_by"), F.col("_bx"), F.lit(buckets_around))))
    near = search(near.select(*keys, F.col("_n.y").alias("_by"), F.col("_n.x").alias("_bx")))
    # both the proven and the open points are taken from here: materialised once, not searched twice
    checked = cut_lineage(here.join(near, keys, "left"))
    proven = F.coalesce(F.col("_best.d") <= _safe_km(size, F.col("latitude")), F.lit(False))
    done = checked.where(proven).select(*keys, "_best")
    rest = checked.where(~proven).select(*keys, "_by", "_bx")

    def shown(found: DataFrame) -> DataFrame:
        return found.select(*keys, *[F.col(f"_best.cell.{f}").alias(f) for f in features],
                            F.col("_best.d").alias("match_distance_km"))

    if rest.limit(1).count() == 0:
        return shown(done)

    # occupied buckets on every level, each with one real cell as a witness
    occupied = there.groupBy(*snap, "_by", "_bx").agg(F.min(F.struct("_lat", "_lon")).alias("_w"))
    raised = occupied.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumns(
        {"_y": _shift(F.col("_by"), F.col("_l")), "_x": _shift(F.col("_bx"), F.col("_l"))})
    pyramid = raised.groupBy(*snap, "_l", "_y", "_x").agg(F.min("_w").alias("_w"))

    def blocks(df: DataFrame) -> DataFrame:
        around = _shift(F.lit(buckets_around), F.col("_l"))
        block = _block(_shift(F.col("_by"), F.col("_l")), _shift(F.col("_bx"), F.col("_l")), around)
        return df.withColumn("_n", F.explode(block)).select(
            *[c for c in df.columns if c not in ("_by", "_bx")], F.col("_n.y").alias("_y"), F.col("_n.x").alias("_x"))

    asked = blocks(rest.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))))
    witness = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_w._lat"), F.col("_w._lon"))
    limits = asked.join(pyramid, [*snap, "_l", "_y", "_x"]).groupBy(*keys).agg(F.min(witness).alias("_limit"))

    level = F.lit(levels - 1)
    for k in range(levels - 1, -1, -1):
        level = F.when(_safe_km(size * 2 ** k, F.col("latitude")) >= F.col("_limit") * _SLACK, k).otherwise(level)
    limited = _bucketed(limits, buckets_around).withColumn("_l", level)
    shortlist = blocks(limited).join(raised.select(*snap, "_l", "_y", "_x", "_by", "_bx"), [*snap, "_l", "_y", "_x"])
    south, west = F.col("_by") * size - 90, F.col("_bx") * size - 180
    lat_gap = F.greatest(F.lit(0.0), south - F.col("latitude"), F.col("latitude") - (south + size))
    offset = F.pmod(F.col("longitude") - west, F.lit(360.0))
    lon_gap = F.when(offset <= size, 0.0).otherwise(F.least(offset - size, 360.0 - offset))
    reach = F.col("_limit") * _SLACK
    side = F.lit(_R) * F.asin(F.cos(F.radians("latitude")) * F.sin(F.radians(F.least(lon_gap, F.lit(90.0)))))
    can_beat = (F.lit(_R) * F.radians(lat_gap) <= reach) & (side <= reach)
    far = search(shortlist.where(can_beat).select(*keys, "_by", "_bx").distinct())

    return shown(done.unionByName(far.select(*keys, "_best")))


def match_points(stations: DataFrame, grid: DataFrame, features: Sequence[str], prefix: str,
                 tie_order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Attach the nearest grid row to each station; no coordinates, no match."""
    matched = nearest_cell(stations, grid, features, tie_order=tie_order)
    out = stations.join(matched, ["latitude", "longitude"], "left")
    return out.select(*stations.columns, *features,
                      F.col("match_distance_km").alias(f"{prefix}_match_distance_km"))
