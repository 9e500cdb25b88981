"""Fits and scoring take all cores, however few parts the input has; a saved model is compared on one scoring."""

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aeroframe.catalog import tables
from aeroframe.catalog.inputs import Inputs
from aeroframe.operators import ml
from aeroframe.plans import flows


def one_part(spark, n=400):
    i = F.col("id")
    return spark.range(n).coalesce(1).select("id", (i % 7).cast("double").alias("a"), (i % 5).cast("double").alias("b"),
                                             (i % 7 + i % 5).cast("double").alias("y"))


class Watched(LinearRegression):
    """Notes the number of partitions that it is fitted on."""

    def fit(self, dataset, params=None):
        seen.append(dataset.rdd.getNumPartitions())
        return LinearRegression(labelCol="label").fit(dataset)

    def copy(self, extra=None):
        return self


seen: list[int] = []


def test_folds_and_comparison_fit_on_all_cores(spark):
    cores, df = spark.sparkContext.defaultParallelism, one_part(spark)
    seen.clear()
    got = ml.cross_validate(df, ["a", "b"], "y", "id", 2, {"m": Watched()}).collect()
    assert len(got) == 2 and seen == [cores, cores]
    assert [r["error"] for r in ml.compare_models(df, df, ["a", "b"], "y", {"m": Watched()}).collect()] == [None]
    assert seen == [cores] * 3


def test_forest_is_fitted_and_scored_on_all_cores(spark, monkeypatch):
    cores, df = spark.sparkContext.defaultParallelism, one_part(spark)
    parts = []
    real = ml.held

    def watched(frame):
        parts.append(frame.rdd.getNumPartitions())
        return real(frame)

    monkeypatch.setattr(ml, "held", watched)
    model = ml.train_forest(df, ["a", "b"], "y", n_trees=2, depth=3)
    scored = ml.score(model, df, ["a", "b"])
    assert parts == [cores]
    assert scored.rdd.getNumPartitions() > cores
    assert scored.columns == ["id", "a", "b", "y", "predicted"] and scored.count() == 400


def test_saved_model_is_compared_on_one_scoring(spark, tmp_path, monkeypatch):
    o = F.col("id")
    spark.range(1, 61).select(
        o.alias("o_orderkey"), (o % 9).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), (o * 1000.0).alias("o_totalprice"),
        F.timestamp_seconds(o * 86400).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    small = ml.train_forest
    monkeypatch.setattr(ml, "train_forest", lambda *a: small(*a, n_trees=2, depth=3))
    scorings = []
    real = ml.score

    def counted(model, df, numeric):
        calls = spark.sparkContext.accumulator(0)
        scorings.append(calls)

        @F.udf("long")
        def passed(x):
            calls.add(1)
            return x

        return real(model, df.withColumn("ordinal", passed("ordinal")), numeric)

    monkeypatch.setattr(ml, "score", counted)
    rows = tables.sink_model(Inputs(spark, str(tmp_path))).collect()
    assert sorted(r["ordinal"] for r in rows) == list(range(43, 61)) and all(r["same_prediction"] for r in rows)
    assert scorings[0].value == 18


def test_flow_keeps_the_rows_it_scored(spark):
    df = one_part(spark).select(F.col("id").alias("ordinal"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
                                (F.col("a") + 280).alias("temperature"), F.col("y").alias("aqi"))
    _, metrics, scored = flows.train_and_score(df, ["temperature"], "aqi", "ts", "ordinal", n_trees=2, depth=3)
    assert "UDF" not in scored._jdf.queryExecution().executedPlan().toString()
    assert metrics.first()["n"] == scored.count() == 120
