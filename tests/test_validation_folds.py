"""Cross-validation from per-fold moments against preprocessing fitted per fold."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aeroframe.operators import ml


@pytest.fixture(scope="module")
def frame(spark):
    dice = random.Random(4)
    rows = [(i, None if dice.random() < 0.1 else 1e6 + dice.gauss(0, 1), dice.gauss(5, 3), 7.0, None if i % 3 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, flat double, c double")
    return df.withColumn("y", F.coalesce("a", F.lit(1e6)) - 1e6 + F.col("b") * 2)


def test_moments_equal_preprocessing_fitted_on_the_fold(frame):
    columns = ["a", "b", "flat", "c"]
    folded = ml.with_folds(frame, "id", 5).cache()
    per_fold = ml.fold_moments(folded, columns)
    for fold in range(5):
        train = folded.where(F.col("fold") != fold)
        prep = ml.fit_preprocessing(train, columns)
        mine = ml.standardised(folded.where(F.col("fold") == fold).orderBy("id"), ml.training_moments(per_fold, fold, columns), "y")
        fitted = prep.transform(ml.as_doubles(folded.where(F.col("fold") == fold).orderBy("id"), columns))
        a, b = ([r[0] for r in f.select(vector_to_array("features")).collect()] for f in (mine, fitted))
        assert len(a) == len(b) > 0
        assert all(x == pytest.approx(y, abs=1e-7) for p, q in zip(a, b) for x, y in zip(p, q))


def test_scores_equal_one_fold_at_a_time(frame):
    models = {"linear": LinearRegression(labelCol="label")}
    got = {r["fold"]: r for r in ml.cross_validate(frame, ["a", "b"], "y", "id", 3, models).collect()}
    folded = ml.with_folds(frame, "id", 3)
    for fold in range(3):
        want = ml.compare_models(folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold), ["a", "b"], "y", models).first()
        assert got[fold + 1]["rmse"] == pytest.approx(want["rmse"], rel=1e-6) and got[fold + 1]["r2"] == pytest.approx(want["r2"], rel=1e-6)


def test_columns_without_values_and_models_that_cannot_fit(frame):
    class Unfit:
        def copy(self):
            return self

        def fit(self, _):
            raise ValueError("no")

    empty = frame.withColumn("none", F.lit(None).cast("double"))
    got = ml.cross_validate(empty, ["b", "none"], "y", "id", 2, {"linear": LinearRegression(labelCol="label"), "unfit": Unfit()}).collect()
    assert {(r["model"], r["fold"]): r["error"] for r in got} == {("linear", 1): None, ("linear", 2): None, ("unfit", 1): "no", ("unfit", 2): "no"}
    assert all(r["rmse"] == float("inf") and r["r2"] == -float("inf") for r in got if r["error"])
