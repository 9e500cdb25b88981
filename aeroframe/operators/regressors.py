"""Estimators of ``pyspark.ml`` whose trees are grown by ``trees``.

They take the parameters of their parents and return the same models, to be saved, loaded and applied as ever.
"""

from __future__ import annotations

import io
import json
import math
import time
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroframe.operators.trees import Binned, Tree, binned, grow_boosted, grow_forest
from aeroframe.session import shared_dir


def saved_form(trees: Sequence[Tree], data: Binned, centres: Sequence[float]) -> pa.Table:
    """Nodes of all trees as ``pyspark.ml`` keeps them."""
    number, ids, stats, gains, left, feature, cut = [], [], [], [], [], [], []
    for t, (tree, centre) in enumerate(zip(trees, centres)):
        n, s, ss = tree.stats
        inner = tree.left != np.arange(len(n))
        number.append(np.full(len(n), t, np.int32))
        ids.append(np.arange(len(n), dtype=np.int32))
        stats.append(np.stack([n, s + n * centre, ss + 2 * centre * s + n * centre * centre, np.maximum(ss / np.maximum(n, 1) - tree.mean ** 2, 0.0), tree.mean + centre]))
        gains.append(np.where(inner, tree.gain / np.maximum(n, 1), -1.0))
        left.append(np.where(inner, tree.left, -1).astype(np.int32))
        feature.append(np.where(inner, tree.feature, -1).astype(np.int32))
        cut.append(np.array([data.cuts[f][c] for f, c in zip(tree.feature[inner], tree.cut[inner])]))
    number, ids, gains, left, feature, cut = (np.concatenate(a) for a in (number, ids, gains, left, feature, cut))
    stats, inner = np.concatenate(stats, 1), feature >= 0
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * 3), pa.array(stats[:3].T.reshape(-1)))
    cuts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inner)).astype(np.int32)), pa.array(cut.astype(np.float64)))
    split = pa.StructArray.from_arrays([pa.array(feature), cuts, pa.array(np.full(len(ids), -1, np.int32))],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    right = np.where(inner, left + 1, -1).astype(np.int32)
    node = pa.StructArray.from_arrays(
        [pa.array(ids), pa.array(stats[4]), pa.array(stats[3]), lists, pa.array(stats[0].astype(np.int64)), pa.array(gains), pa.array(left), pa.array(right), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": pa.array(number), "nodeData": node})


def as_model(estimator, kind: type, trees: Sequence[Tree], weights: Sequence[float], centres: Sequence[float], data: Binned):
    """The trees as a model of ``pyspark.ml``, by way of its saved form in the shared folder."""
    spark: SparkSession = data.frame.sparkSession
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"

    def described(name: str, uid: str, **more) -> str:
        own = {p.name: v for p, v in estimator._paramMap.items()}
        default = {p.name: v for p, v in estimator._defaultParamMap.items()}
        return json.dumps({"class": f"org.apache.spark.ml.regression.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": own, "defaultParamMap": default, "numFeatures": len(data.cuts), **more})

    def described_tree(uid: str) -> str:
        return json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": {}, "defaultParamMap": {}, "numFeatures": len(data.cuts)})

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)

    def put(name: str, content: bytes) -> None:
        out = files.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(content)
        out.close()

    def table(columns: pa.Table) -> bytes:
        buffer = io.BytesIO()
        pq.write_table(columns, buffer)
        return buffer.getvalue()

    n = len(trees)
    put("metadata/part-00000", described(kind.__name__, estimator.uid, numTrees=n).encode())
    put("treesMetadata/part-00000.parquet", table(pa.table({
        "_1": pa.array(range(n), pa.int32()), "_2": [described_tree(f"dtr_{uuid.uuid4().hex[:12]}") for _ in trees], "_3": pa.array(map(float, weights), pa.float64())})))
    put("data/part-00000.parquet", table(saved_form(trees, data, centres)))
    model = kind.load(path)
    files.delete(folder, True)
    return model


def tried(strategy: str, d: int, one_tree: bool) -> int:
    """Features tried per node, by the names that ``pyspark.ml`` takes."""
    if strategy == "auto":
        strategy = "all" if one_tree else "onethird"
    named = {"all": d, "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))) if d else 1, "onethird": math.ceil(d / 3)}
    if strategy in named:
        return named[strategy]
    return min(d, int(strategy)) if "." not in strategy else max(1, math.ceil(float(strategy) * d))


def _plain(estimator) -> bool:
    """Parameters that are not built here are left to ``pyspark.ml``."""
    get = estimator.getOrDefault
    return not estimator.isDefined("weightCol") and get("minWeightFractionPerNode") == 0 and get("minInfoGain") == 0 and \
        get("subsamplingRate") == 1 and get("maxBins") <= 256


def _rows(estimator, dataset: DataFrame) -> Binned:
    x, y = vector_to_array(F.col(estimator.getFeaturesCol())), F.col(estimator.getLabelCol()).cast("double")
    return binned(dataset.select(x.alias("x"), y.alias("y")), estimator.getMaxBins())


class Forest(RandomForestRegressor):
    """``RandomForestRegressor``, fitted by ``grow_forest``."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        if not _plain(self):
            return super()._fit(dataset)
        data = _rows(self, dataset)
        n = self.getNumTrees()
        width = tried(self.getFeatureSubsetStrategy(), len(data.cuts), n == 1)
        trees = grow_forest(data, n, self.getMaxDepth(), width, self.getMinInstancesPerNode(), self.getBootstrap() and n > 1, self.getSeed())
        return as_model(self, RandomForestRegressionModel, trees, [1.0] * n, [data.centre] * n, data)


class Boosted(GBTRegressor):
    """``GBTRegressor`` for squared errors, fitted by ``grow_boosted``."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        if not _plain(self) or self.getLossType() != "squared" or self.isDefined("validationIndicatorCol"):
            return super()._fit(dataset)
        data = _rows(self, dataset)
        n = self.getMaxIter()
        width = tried(self.getFeatureSubsetStrategy(), len(data.cuts), True)
        trees = grow_boosted(data, n, self.getMaxDepth(), width, self.getMinInstancesPerNode(), self.getStepSize(), self.getSeed())
        return as_model(self, GBTRegressionModel, trees, [1.0] + [self.getStepSize()] * (n - 1), [data.centre] + [0.0] * (n - 1), data)
