"""Nearest cell and nearest time against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aeroframe.operators import align, spatial
from aeroframe.plans import flows

R = 6371.0088


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def check(spark, points, cells, around=256):
    p = spark.createDataFrame(points, "latitude double, longitude double")
    c = spark.createDataFrame([(i, *xy, float(i)) for i, xy in enumerate(cells)], "ordinal long, latitude double, longitude double, f double")
    got = {(x.latitude, x.longitude): (x.match_distance_km, x.f) for x in spatial.nearest_cell(p, c, ["f"], buckets_around=around).collect()}
    assert len(got) == len(set(points))
    for y, x in points:
        want = min(km(y, x, *cell) for cell in cells)
        assert got[(y, x)][0] == pytest.approx(want, abs=1e-6), (y, x)
        near = int(got[(y, x)][1])
        assert km(y, x, *cells[near]) == pytest.approx(want, abs=1e-6)


def test_world_poles_and_date_line(spark):
    rnd = random.Random(1)
    points = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)] + [
        (90.0, 0.0), (-90.0, 17.0), (89.9, 179.9), (0.0, 180.0), (0.0, -180.0), (12.0, -179.99), (-45.0, 179.99)]
    check(spark, points, [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(40)])


def test_few_far_cells(spark):
    rnd = random.Random(2)
    points = [(rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for _ in range(25)]
    check(spark, points, [(10.0, 20.0)])
    check(spark, points, [(10.0, 20.0), (-70.0, -160.0), (85.0, 100.0)], around=64)


def test_hot_bucket_and_copies(spark):
    rnd = random.Random(3)
    crowd = [(20 + rnd.random() * 0.01, 77 + rnd.random() * 0.01) for _ in range(300)]
    cells = crowd + [crowd[0]] * 200 + [(rnd.uniform(6, 38), rnd.uniform(68, 98)) for _ in range(60)]
    check(spark, [(20.005, 77.005), (20.0, 77.0), (37.0, 97.0), (6.0, 68.0)], cells)


def test_first_row_wins_a_tie(spark):
    p = spark.createDataFrame([(0.0, 0.0)], "latitude double, longitude double")
    c = spark.createDataFrame([(5, 0.0, 1.0, 5.0), (2, 0.0, -1.0, 2.0), (9, 1.0, 0.0, 9.0)], "ordinal long, latitude double, longitude double, f double")
    assert spatial.nearest_cell(p, c, ["f"]).collect()[0].f == 2.0


def test_missing_coordinates_do_not_match(spark):
    s = spark.createDataFrame([("a", None, 70.0), ("b", 10.0, 70.0)], "name string, latitude double, longitude double")
    g = spark.createDataFrame([(1, 10.0, None, 1.0), (2, 11.0, 70.0, 2.0)], "ordinal long, latitude double, longitude double, f double")
    got = {x.name: x.f for x in spatial.match_points(s, g, ["f"], "x").collect()}
    assert got == {"a": None, "b": 2.0}


def test_nearest_time_ties_gaps_and_ends(spark):
    base = 1_704_067_200
    times = [0, 3600, 3601, 40 * 3600, 400 * 3600 + 7]
    grid = spark.createDataFrame([(t,) for t in times + [3600]], "s long").select(F.timestamp_seconds(F.col("s") + base).alias("grid_ts"))
    asked = [-10 ** 6, 0, 1799, 1800, 1801, 3600, 3601, 20 * 3600, 20 * 3600 + 1800 + 1, 220 * 3600, 10 ** 7]
    obs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "id long, s long").select("id", F.timestamp_seconds(F.col("s") + base).alias("ts"))
    obs = obs.unionByName(spark.range(1).select((F.col("id") + 99).alias("id"), F.lit(None).cast("timestamp").alias("ts")))
    got = {x.id: x.s for x in align.asof_nearest_time(obs, grid).select("id", F.unix_timestamp("snapshot_ts").alias("s")).collect()}
    assert got.pop(99) is None
    for i, t in enumerate(asked):
        assert got[i] - base == min(times, key=lambda g: (abs(g - t), g)), t


def test_reference_tolerance_is_inclusive(spark):
    obs = spark.sql("select * from values (1, timestamp'2024-01-01 01:00:00'), (2, timestamp'2024-01-01 01:00:01') t(id, ts)")
    ref = spark.sql("select timestamp'2024-01-01 00:00:00' ref_ts")
    assert [x.id for x in align.match_reference_times(obs, ref).collect()] == [1]


def test_no_frame_that_is_walked_anew_for_each_row(spark):
    obs = spark.sql("select * from values (1, timestamp'2024-01-01 01:00:00', 10.0D, 70.0D), (2, timestamp'2024-01-02 03:00:01', 11.0D, 71.0D) t(ordinal, ts, latitude, longitude)")
    grid = spark.sql("select 1 as ordinal, timestamp'2024-01-01 00:00:00' as timestamp, 10.0D as latitude, 70.5D as longitude, 1.0D as aod")
    made = [align.asof_nearest_time(obs, grid, grid_ts="timestamp"), align.match_reference_times(obs, grid, reference_ts="timestamp"),
            flows.attach_grid(obs, grid, ["aod"], "satellite")]
    for df in made:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert {x.ordinal: x.aod for x in made[2].collect()} == {1: 1.0, 2: 1.0}


def test_integration_has_no_frame_that_is_walked_anew_for_each_row(spark):
    obs = spark.sql("select * from values (1L, timestamp'2024-01-01 01:00:00', 'a', 5.0D), (2L, timestamp'2024-01-02 03:00:01', 'b', 6.0D), (3L, timestamp'2024-01-02 04:00:00', 'c', 7.0D) t(ordinal, ts, station_name, pm25)")
    registry = spark.sql("select * from values ('1', 'a', 'x', 'y', 10.0D, 70.0D), ('2', 'b', 'x', 'y', 11.0D, 71.0D) t(station_id, station_name, city, state, latitude, longitude)")
    grid = spark.sql("select 1L as ordinal, timestamp'2024-01-01 00:00:00' as timestamp, 10.0D as latitude, 70.5D as longitude, 1.0D as aod, 280.0D as temperature")
    made = flows.integrate(obs, registry, grid.drop("temperature"), grid.drop("aod"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert {x.ordinal: (x.aod, x.temperature) for x in made.collect()} == {1: (1.0, 280.0), 2: (1.0, 280.0), 3: (None, None)}
