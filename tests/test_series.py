"""Fills, splits and quantiles against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import fill, orderstat, ordinal, split


@pytest.fixture(scope="module")
def series(spark):
    rnd = np.random.default_rng(4)
    n = 300
    # one station holds most rows, many rows share one moment
    pdf = pd.DataFrame({
        "ordinal": np.arange(n), "station_id": np.where(rnd.random(n) < 0.6, 1, rnd.integers(2, 6, n)),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rnd.integers(0, 90, n) * 3600, unit="s"),
        "x": np.where(rnd.random(n) < 0.5, np.nan, rnd.normal(size=n).round(3))})
    pdf.loc[pdf.station_id == 5, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf.sort_values(["station_id", "ts", "ordinal"]), df


def close(df, want):
    got = df.toPandas().sort_values("ordinal").x.astype(float).to_numpy()
    np.testing.assert_allclose(got, want.sort_index().to_numpy(dtype=float), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("chunk", ["hour", "day", "year"])
def test_forward_fill(series, chunk):
    pdf, df = series
    close(fill.forward_fill(df, ["x"], chunk=chunk), pdf.groupby("station_id").x.ffill())


@pytest.mark.parametrize("chunk", ["hour", "day", "year"])
def test_interpolation(series, chunk):
    pdf, df = series
    want = pdf.groupby("station_id").x.transform(lambda g: g.interpolate(limit_direction="both"))
    close(fill.interpolate(df, ["x"], chunk=chunk), want)


def test_station_median(series):
    pdf, df = series
    close(fill.station_median(df, ["x"]), pdf.x.fillna(pdf.groupby("station_id").x.transform("median")))


def test_unknown_strategy(series):
    with pytest.raises(ValueError):
        fill.apply_strategy(series[1], "guess", ["x"])
    assert fill.apply_strategy(series[1], "leave_missing", ["x"]) is series[1]


def test_large_offset_and_small_spread_are_cut_finely(spark):
    """No step ranks more than a bounded number of buckets, and the last one few distinct values."""
    n = 200_000
    base = spark.range(n).select((F.lit(101_325.0) + (F.col("id") * 7919 % n) / n * 0.2 - 0.1).alias("x"))
    got = {r.probability: r.value for r in orderstat.exact_quantiles(base, ["x"], [0.25, 0.5]).collect()}
    values = np.sort(np.array([101_325.0 + i / n * 0.2 - 0.1 for i in range(n)]))
    assert got[0.25] == pytest.approx(np.quantile(values, 0.25), abs=1e-9) and got[0.5] == pytest.approx(np.quantile(values, 0.5), abs=1e-9)
    buckets = base.select(orderstat.magnitude_bucket(F.col("x")).alias("b"), "x")
    hot = buckets.groupBy("b").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("x").alias("n")).orderBy(F.desc("n")).first()
    assert hot["n"] > n / 4                                   # magnitude alone does not separate them
    step = F.floor((F.col("x") - hot["lo"]) / (hot["hi"] - hot["lo"]) * orderstat.EVEN_STEPS)
    assert buckets.where(F.col("b") == hot["b"]).groupBy(step).agg(F.count_distinct("x").alias("n")).agg(F.max("n")).first()[0] <= 2 * n / orderstat.EVEN_STEPS


def test_quantiles_of_awkward_values(spark):
    values = [0.0, -0.0, 1e-300, -1e-300, 1e300, -5.5, 3.0, 3.0, 3.0, 3.0, 2 ** 53 + 1.0, 7.25, -1e-9] + [42.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.probability: r.value for r in orderstat.exact_quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(values, p)), rel=1e-12), p


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert orderstat.exact_quantiles(df, ["x"], [0.5]).collect() == []


@pytest.mark.parametrize("partitions", [1, 16])
def test_split_sizes_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(0, 1003).select("id", F.timestamp_seconds(F.col("id") % 7).alias("ts")).repartition(partitions)
    labelled = split.chronological_split(df, "ts", "id")
    counts = {r.split: r.n_rows for r in split.split_summary(labelled).collect()}
    assert counts == {"train": int(1003 * 0.7), "validation": int(1003 * 0.15), "test": 1003 - int(1003 * 0.7) - int(1003 * 0.15)}
    order = {r.id: (r.ts, r.id) for r in df.collect()}
    got = {r.id: r.split for r in labelled.collect()}
    assert max(order[i] for i in got if got[i] == "train") < min(order[i] for i in got if got[i] == "validation")


def test_split_puts_missing_times_last_and_checks_ratios(spark):
    df = spark.sql("select * from values (1, null), (2, timestamp'2024-01-02'), (3, timestamp'2024-01-01') t(id, ts)")
    got = {r.id: r.split for r in split.holdout_split(df, "ts", "id").collect()}
    assert got == {3: "train", 2: "train", 1: "test"}
    with pytest.raises(ValueError):
        split.chronological_split(df, "ts", "id", (0.5, 0.2, 0.2))


def test_small_reference_split(spark):
    days = ["2026-07-03", "2026-07-01", "2026-07-05", "2026-07-02", "2026-07-04"]
    df = spark.createDataFrame([(i, d, float(d[-1]) * 10) for i, d in enumerate(days)], "id long, d string, v double").withColumn("ts", F.to_timestamp("d"))
    labelled = split.holdout_split(df, "ts", "id", 0.6)
    assert sorted(r.v for r in labelled.where("split = 'train'").collect()) == [10, 20, 30]


def test_random_split_is_exact_and_repeatable(spark):
    df = spark.range(10)
    first = {r.id: r.split for r in split.random_split(df, "id", 0.8).collect()}
    assert sorted(first.values()).count("train") == 8
    assert first == {r.id: r.split for r in split.random_split(df.repartition(7), "id", 0.8).collect()}


def test_ordinal_over_hot_key(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    got = ordinal.materialise_ordinal(df, ["k", "id"]).orderBy("k", "id").collect()
    assert [r.ordinal for r in got] == list(range(5000))
