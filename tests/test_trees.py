"""Trees grown in numpy: one part or many, against plain least squares and the models of pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from aeroframe.operators import ml, regressors, trees


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.random(3000), rng.integers(0, 6, 3000), rng.random(3000), rng.integers(0, 2, 3000)], 1)
    y = 1e5 + np.sin(6 * x[:, 0]) * x[:, 1] + 4 * x[:, 3] + rng.normal(0, 0.1, 3000)
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return df.select("id", array_to_vector("x").alias("features"), "label").repartition(4, "id").cache()


def predictions(model, frame):
    return np.array([r["prediction"] for r in model.transform(frame).orderBy("id").collect()])


def rmse(model, frame):
    labels = np.array([r["label"] for r in frame.orderBy("id").collect()])
    return float(np.sqrt(((predictions(model, frame) - labels) ** 2).mean()))


def test_forest_in_parts_is_the_forest_in_one_part(frame, monkeypatch):
    est = regressors.Forest(numTrees=3, maxDepth=8, bootstrap=False, featureSubsetStrategy="sqrt", seed=5)
    whole = est.fit(frame)
    monkeypatch.setattr(trees, "PART_ROWS", 700)
    parts = est.fit(frame)
    assert whole.totalNumNodes == parts.totalNumNodes > 3 * 256      # more than one range of nodes in a level
    assert np.allclose(predictions(whole, frame), predictions(parts, frame), atol=1e-6)
    assert np.allclose(whole.featureImportances.toArray(), parts.featureImportances.toArray())


def test_boosting_in_parts_is_boosting_in_one_part(frame, monkeypatch):
    est = regressors.Boosted(maxIter=12, maxDepth=3, minInstancesPerNode=3, seed=5)
    whole = est.fit(frame)
    monkeypatch.setattr(trees, "PART_ROWS", 700)
    monkeypatch.setattr(trees, "ALONE_ROWS", 700)
    parts = est.fit(frame)
    assert whole.treeWeights == parts.treeWeights == [1.0] + [0.1] * 11
    assert np.allclose(predictions(whole, frame), predictions(parts, frame), atol=1e-6)


def test_models_are_as_good_as_those_of_spark(frame):
    train, judge = frame.where("id % 5 > 0"), frame.where("id % 5 = 0")
    for mine, theirs, options in ((regressors.Forest, RandomForestRegressor, {"numTrees": 20, "maxDepth": 8, "featureSubsetStrategy": "all"}),
                                  (regressors.Boosted, GBTRegressor, {"maxIter": 20, "maxDepth": 3})):
        a, b = (kind(seed=1, **options).fit(train) for kind in (mine, theirs))
        assert type(a) is type(b) and rmse(a, judge) < 1.1 * rmse(b, judge)
        assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=0.1)


def test_nodes_are_kept_like_those_of_spark(spark, frame, tmp_path):
    model = ml.forest(2, 3, "all").setBootstrap(False).fit(frame)
    model.write().save(f"{tmp_path}/m")
    loaded = RandomForestRegressionModel.load(f"{tmp_path}/m")
    assert np.array_equal(predictions(model, frame), predictions(loaded, frame)) and loaded.getMaxDepth() == 3 and loaded.getNumTrees == 2
    nodes = [r["nodeData"] for r in spark.read.parquet(f"{tmp_path}/m/data").where("treeID = 0").collect()]
    labels = np.array([r["label"] for r in frame.collect()])
    root = next(n for n in nodes if n["id"] == 0)
    assert root["rawCount"] == 3000 and root["prediction"] == pytest.approx(labels.mean()) and root["impurity"] == pytest.approx(labels.var())
    by_id = {n["id"]: n for n in nodes}
    for n in nodes:
        if n["leftChild"] >= 0:
            sides = [by_id[n["leftChild"]], by_id[n["rightChild"]]]
            assert sum(s["rawCount"] for s in sides) == n["rawCount"]
            assert n["impurity"] - sum(s["impurity"] * s["rawCount"] for s in sides) / n["rawCount"] == pytest.approx(n["gain"], abs=1e-6)


def test_a_split_is_that_of_least_squares():
    rng = np.random.default_rng(0)
    codes, y, weight = rng.integers(0, 8, (500, 3)).astype(np.uint8), rng.normal(size=500), trees.copies(500, 1)
    y += codes[:, 1] > 4
    ask = trees.open_nodes([trees.Tree()], [np.zeros(1, np.intp)], 3, 3, 0, True)[0]
    sums = ask.sums(8)
    ask.add(sums, codes, y, weight, 8)
    gain, feature, cut, left, total = trees.best(sums.reshape(len(sums), 1, 8), ask.looked, 1)

    def cost(on):
        w, v = weight[on].astype(float), y[on]
        return (w * (v - np.average(v, weights=w)) ** 2).sum() if w.sum() else 0.0

    costs = {(f, c): cost(codes[:, f] <= c) + cost(codes[:, f] > c) for f in range(3) for c in range(7)}
    assert costs[feature[0], cut[0]] == pytest.approx(min(costs.values())) and gain[0] == pytest.approx(cost(y > -9) - min(costs.values()))
    assert total[0, 0] == weight.sum() and left[0, 0] == weight[codes[:, feature[0]] <= cut[0]].sum()
    assert trees.copies(100_000, 2).mean() == pytest.approx(1, abs=0.02) and trees.copies(100_000, 2).var() == pytest.approx(1, abs=0.03)


def test_a_rare_value_has_a_cut_of_its_own(spark):
    i = F.col("id")
    df = spark.range(40_000).select("id", array_to_vector(F.array((i == 7).cast("double"), (i % 40).cast("double"))).alias("features"),
                                    F.when(i == 7, 1000.0).otherwise(0.0).alias("label"))
    model = ml.forest(1, 2, "all").fit(df)
    assert model.transform(df.where("id = 7")).first()["prediction"] == 1000.0


def test_flat_labels_empty_tables_and_labels_that_are_missing(spark, frame):
    flat = frame.withColumn("label", F.lit(7.5))
    assert ml.forest(2, 4).fit(flat).totalNumNodes == 2
    assert set(predictions(regressors.Boosted(maxIter=3).fit(flat), flat)) == {7.5}
    with pytest.raises(ValueError):
        ml.forest(2, 4).fit(frame.where("id < 0"))
    for est in (ml.forest(2, 4), regressors.Boosted(maxIter=2)):
        with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
            est.fit(frame.withColumn("label", F.when(F.col("id") != 5, F.col("label"))))


def test_boosted_trees_of_few_rows_take_few_jobs(spark, frame):
    flat = frame.select("id", F.rand(1).alias("a"), F.col("label").alias("y"))
    context = spark.sparkContext
    context.setJobGroup("folds", "folds")
    try:
        got = ml.cross_validate(flat, ["a"], "y", "id", 2, {ml.BOOSTED: ml.regressors(n_trees=30)[ml.BOOSTED]}).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("folds"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 2 and all(r["error"] is None for r in got)
    assert 0 < jobs < 60          # a pass per level and tree would be 180
