"""Station registry: consolidation, coordinates, checks against an official list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aeroframe import values as V
from aeroframe.functions.text import folded
from aeroframe.operators.columns import rename_station_columns
from aeroframe.operators.ordinal import materialise_ordinal


def city_table(spark) -> DataFrame:
    """The fixed list of city coordinates."""
    rows = [(c, lat, lon) for c, (lat, lon) in V.CITY_COORDINATES.items()]
    return spark.createDataFrame(rows, "city_key string, city_lat double, city_lon double")


def city_coordinates(df: DataFrame, city: str = "city") -> DataFrame:
    """Add ``city_lat`` and ``city_lon``; unknown cities give nulls."""
    key = F.lower(F.trim(F.col(city)))
    return (df.withColumn("city_key", key)
            .join(F.broadcast(city_table(df.sparkSession)), "city_key", "left").drop("city_key"))


def join_station_metadata(obs: DataFrame, stations: DataFrame, name: str = "station_name") -> DataFrame:
    """Left join on the station name; null matches null, clashing columns get ``_metadata``."""
    clashes = [c for c in stations.columns if c in obs.columns and c != name]
    right = stations.withColumnsRenamed({**{c: f"{c}_metadata" for c in clashes}, name: "_name"})
    on = F.col(name).eqNullSafe(F.col("_name"))
    return obs.join(right, on, "left").drop("_name")


def consolidate(source_a: DataFrame, source_b: DataFrame) -> DataFrame:
    """One registry row per station name from two sources.

    a: station, city, state, last_update, ordinal. b: station, city, latitude, longitude, utc_time,
    ordinal. The last row of a source wins; b's coordinates win over the city list when both are
    known. Numbering needs the global name order and checkpoints (an action).
    """
    last_a = source_a.where(F.col("station").isNotNull()).groupBy("station").agg(
        F.max(F.struct("ordinal", "city", "state", "last_update")).alias("a"))
    a = city_coordinates(last_a.select("station", F.col("a.city").alias("city"), F.col("a.state").alias("state"),
                                       F.col("a.last_update").alias("last_update")))
    both_known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    b = source_b.where(F.col("station").isNotNull()).groupBy("station").agg(
        F.min(F.struct("ordinal", "city", "utc_time", "latitude", "longitude")).alias("b"),
        F.max(F.when(both_known, F.struct("ordinal", "latitude", "longitude"))).alias("known"))
    joined = a.withColumnRenamed("station", "_a").join(
        b.withColumnRenamed("station", "_b"), F.col("_a") == F.col("_b"), "full_outer")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    first_b = {c: F.col(f"b.{c}") for c in ("latitude", "longitude")}
    rows = joined.select(
        F.coalesce("_a", "_b").alias("station_name"),
        F.when(in_a, F.col("city")).otherwise(F.col("b.city")).alias("city"),
        F.when(in_a, F.col("state")).otherwise(F.lit("")).alias("state"),
        F.when(in_a, F.coalesce("known.latitude", "city_lat"))
         .otherwise(F.coalesce("known.latitude", first_b["latitude"])).alias("latitude"),
        F.when(in_a, F.coalesce("known.longitude", "city_lon"))
         .otherwise(F.coalesce("known.longitude", first_b["longitude"])).alias("longitude"),
        F.when(in_a & in_b, "CPCB, OpenAQ").when(in_a, "CPCB").otherwise("OpenAQ").alias("source"),
        F.when(in_a, F.col("last_update")).otherwise(F.col("b.utc_time")).alias("last_updated"),
    )
    numbered = materialise_ordinal(rows, ["station_name"], "_i")
    return numbered.select(F.format_string("STN_%03d", F.col("_i") + 1).alias("station_id"), *rows.columns)


def flag_duplicates(stations: DataFrame, keys: Sequence[str] = ("station_name", "city", "state"),
                    name: str = "is_duplicate") -> DataFrame:
    """Flag every member of a repeated group; nulls compare equal.

    Repeated groups are counted with map-side combining; rows look their group up.
    """
    repeated = stations.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias("_n")).where("_n > 1")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return stations.join(repeated, on, "left").select(*stations.columns, F.col("_n").isNotNull().alias(name))


def field_warnings(duplicate: Column) -> Column:
    """Ordered list of what is wrong with a registry row."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    checks = [
        (folded(F.col("latitude")) == "", "missing_latitude"),
        (folded(F.col("longitude")) == "", "missing_longitude"),
        (folded(F.col("city")) == "", "missing_city"),
        (folded(F.col("state")) == "", "missing_state"),
        (duplicate, "duplicate_station"),
        ((lat < -90) | (lat > 90), "invalid_latitude_range"),
        ((lon < -180) | (lon > 180), "invalid_longitude_range"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks]))


_FIELDS = ("station_id", "station_name", "city", "state", "latitude", "longitude")


def official_lookup(stations: DataFrame, official: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Add struct ``official``: the official row with the same id, else with the same name and city.

    Later official rows overwrite earlier ones of the same key; empty ids and names are no key.
    """
    row = F.struct(*[F.col(c) for c in _FIELDS if c in official.columns])
    keyed = official.select(
        folded(F.col("station_id")).alias("_id"), folded(F.col("station_name")).alias("_name"),
        folded(F.col("city")).alias("_city"), F.struct(F.col(ordinal), row.alias("row")).alias("_row"))
    by_id = keyed.where("_id <> ''").groupBy("_id").agg(F.max("_row").alias("_by_id"))
    by_name = keyed.where("_name <> ''").groupBy("_name", "_city").agg(F.max("_row").alias("_by_name"))
    asked = stations.withColumns({
        "_id": folded(F.col("station_id")), "_name": folded(F.col("station_name")), "_city": folded(F.col("city"))})
    return (asked.join(by_id, "_id", "left")
            .join(by_name, ["_name", "_city"], "left")
            .select(*stations.columns, F.coalesce("_by_id.row", "_by_name.row").alias("official")))


def mismatched_fields(tolerance: float = 0.01) -> Column:
    """Names of the fields that differ from ``official``, joined by ``|``."""
    tests = [(folded(F.col(c)) != folded(F.col(f"official.{c}")), c)
             for c in ("station_id", "station_name", "city", "state")]
    for c in ("latitude", "longitude"):
        gap = F.abs(F.col(c).try_cast("double") - F.col(f"official.{c}").try_cast("double"))
        tests.append((gap > tolerance, c))
    names = F.array_compact(F.array(*[F.when(test, F.lit(c)) for test, c in tests]))
    return F.when(F.col("official").isNotNull(), F.concat_ws("|", names)).otherwise("")


def check_registry(stations: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """Registry with ``warnings`` and ``mismatch_fields``."""
    registry = rename_station_columns(stations)
    for c in _FIELDS:
        if c not in registry.columns:
            registry = registry.withColumn(c, F.lit(None).cast("string"))
    flagged = flag_duplicates(registry)
    notes = field_warnings(F.col("is_duplicate"))
    if official is None:
        return flagged.select(*registry.columns, F.concat_ws("; ", notes).alias("warnings"),
                              F.lit("").alias("mismatch_fields"))
    looked = official_lookup(flagged, rename_station_columns(official)).withColumn("mismatch_fields", mismatched_fields())
    extra = F.when(F.col("official").isNull(), F.lit("official_station_not_matched")).when(
        F.col("mismatch_fields") != "", F.concat(F.lit("official_metadata_mismatch:"), "mismatch_fields"))
    full = F.concat_ws("; ", F.array_compact(F.concat(notes, F.array(extra))))
    return looked.select(*registry.columns, full.alias("warnings"), "mismatch_fields")


def registry_totals(checked: DataFrame) -> DataFrame:
    bad = F.col("warnings").contains("invalid_latitude_range") | F.col("warnings").contains("invalid_longitude_range")
    return checked.agg(
        F.count(F.lit(1)).alias("n_stations"), F.count_if(F.col("warnings") != "").alias("with_warnings"),
        F.count_if(bad).alias("invalid_coordinates"), F.count_if(F.col("mismatch_fields") != "").alias("mismatches"))
