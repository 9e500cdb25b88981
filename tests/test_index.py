"""Hand-worked index cases."""

import pytest
from pyspark.sql import functions as F

from aeroframe.functions import aqi as ax


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("value, want", [(31.0, 51), (60.0, 100), (45.0, 75), (450.0, 500), (-10.0, None), (float("nan"), None), (None, None),
                                         (30.0, 50), (30.9999999, 51), (0.0, 0), (380.0, 500), (380.9, 500)])
def test_pm25_points(spark, value, want):
    assert one(spark, ax.sub_index("PM2.5", F.lit(value).cast("double"))) == want


def test_unrounded_and_half_even(spark):
    assert one(spark, ax.sub_index("PM2.5", F.lit(45.0), rounded=False)) == pytest.approx(74.655172, abs=1e-6)
    assert one(spark, ax.sub_index("NO2", F.lit(2.0))) == 2          # 2.5 goes to the even number
    assert one(spark, ax.sub_index("CO", F.lit(1.1))) == 51


@pytest.mark.parametrize("pollutant", ["CO", "Pb"])
def test_tenths_survive_truncation(spark, pollutant):
    rows = spark.range(0, 500).select((F.col("id") / 10).alias("x")).select(
        "x", ax.truncate_concentration(pollutant, F.col("x")).alias("cut"))
    assert rows.where("x <> cut").count() == 0


@pytest.mark.parametrize("raw, want", [("pm25", "PM2.5"), (" PM-10 ", "PM10"), ("ozone", "O3"), ("Lead", "Pb"), ("pm 2.5", "PM2.5"), ("xylene", None)])
def test_names(spark, raw, want):
    assert one(spark, ax.standard_pollutant_name(F.lit(raw))) == want


@pytest.mark.parametrize("given, want", [({"PM2.5": 1.0, "NO2": 1.0, "CO": 1.0}, True), ({"SO2": 1.0, "NO2": 1.0, "CO": 1.0}, False), ({"PM2.5": 1.0, "NO2": 1.0}, False)])
def test_requirements(spark, given, want):
    assert one(spark, ax.requirements_met({k: F.lit(v) for k, v in given.items()})) is want


def test_overall_and_ties(spark):
    df = spark.createDataFrame([(45.0, 80.0, 50.0)], "pm25 double, pm10 double, no2 double")
    row = ax.with_index(df, tied=True).collect()[0]
    assert (row.pm25_index, row.pm10_index, row.no2_index, row.aqi, row.dominant) == (75, 80, 62, 80, "PM10")
    tie = spark.createDataFrame([(60.0, 100.0, 40.0)], "pm25 double, pm10 double, no2 double")
    row = ax.with_index(tie, tied=True).collect()[0]
    assert (row.aqi, row.dominant, row.tied) == (100, "PM10", ["PM10", "PM2.5"])
    two = spark.createDataFrame([(45.0, 50.0)], "pm25 double, no2 double")
    assert ax.with_index(two).collect()[0].aqi == 75
    assert ax.with_index(two, enforce_requirements=True).collect()[0].aqi is None


@pytest.mark.parametrize("value, want", [(0, "Good"), (50, "Good"), (50.1, "Satisfactory"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"),
                                         (400, "Very Poor"), (401, "Severe"), (999, "Severe"), (None, None)])
def test_category(spark, value, want):
    assert one(spark, ax.category(F.lit(value).cast("double"))) == want
