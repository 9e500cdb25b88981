"""Model building on pyspark.ml: preprocessing, training, comparison, validation, tuning, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeroframe import values as V
from aeroframe.operators.regressors import Boosted, Forest
from aeroframe.operators.scoring import regression_metrics

LINEAR, FOREST, EXTRA, BOOSTED = (
    "Linear Regression", "Random Forest Regressor", "Extra Trees Regressor", "Gradient Boosting Regressor")


@contextmanager
def held(df: DataFrame):
    """Keep a table in executor storage while an iterative fit reads it again and again."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Rows dealt evenly over all cores, for work that costs far more than moving them.

    A file of few row groups would else be fitted or scored by as few tasks. In the fit of a forest every partition
    sends statistics of all nodes of a level, so it takes one per core.
    """
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric and boolean features as doubles, the type imputers take."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent category per column, smallest name on a tie (collects one row per column)."""
    out = {}
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect()
        out[c] = top[0][0] if top else ""
    return out


def _filling(modes: dict[str, str]) -> SQLTransformer:
    """Stage that gives ``<column>_known`` with nulls replaced; it is saved with the pipeline."""
    quoted = {c: "'" + m.replace("\\", "\\\\").replace("'", "\\'") + "'" for c, m in modes.items()}
    columns = ", ".join(f"coalesce(`{c}`, {m}) AS `{c}_known`" for c, m in quoted.items())
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


def preprocessing_stages(numeric: Sequence[str], modes: dict[str, str] | None = None) -> list:
    """Mean imputation and standardisation of ``numeric``; most frequent value and one-hot encoding of the
    categorical columns in ``modes``. A category not seen in training has a slot of its own.

    The labels of a categorical column reach the driver, so it must have few distinct values.
    """
    stages, modes = [], modes or {}
    if numeric:
        filled = [f"{c}_filled" for c in numeric]
        stages += [
            Imputer(inputCols=list(numeric), outputCols=filled, strategy="mean"),
            VectorAssembler(inputCols=filled, outputCol="numeric_raw"),
            StandardScaler(inputCol="numeric_raw", outputCol="numeric_scaled", withMean=True, withStd=True)]
    if modes:
        stages.append(_filling(modes))
    for c in modes:
        stages += [StringIndexer(inputCol=f"{c}_known", outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot", dropLast=True, handleInvalid="keep")]
    inputs = (["numeric_scaled"] if numeric else []) + [f"{c}_hot" for c in modes]
    return stages + [VectorAssembler(inputCols=inputs, outputCol="features")]


def fit_preprocessing(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> PipelineModel:
    with held(as_doubles(train.select(*numeric, *categorical), numeric)) as rows:
        return Pipeline(stages=preprocessing_stages(numeric, most_frequent(rows, categorical))).fit(rows)


def scaling_table(model: PipelineModel, numeric: Sequence[str], spark) -> DataFrame:
    """Fitted mean (imputation and centre) and sample deviation per numeric feature."""
    scaler = next(s for s in model.stages if hasattr(s, "std") and hasattr(s, "mean"))
    rows = [(c, float(scaler.mean[i]), float(scaler.std[i])) for i, c in enumerate(numeric)]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


def forest(n_trees: int = 100, depth: int = 12, features: str = "sqrt", label: str = "label") -> RandomForestRegressor:
    return Forest(numTrees=n_trees, maxDepth=depth, featureSubsetStrategy=features,
                  labelCol=label, seed=V.SEED, cacheNodeIds=True, maxMemoryInMB=512)


def regressors(label: str = "label", n_trees: int = 100, depth: int = 8) -> dict[str, object]:
    """The four models compared. Extra-trees has no class of its own: a forest without bootstrap stands in."""
    return {
        LINEAR: LinearRegression(labelCol=label),
        FOREST: forest(n_trees, depth, "all", label),
        EXTRA: forest(n_trees, depth, "all", label).setBootstrap(False).setFeatureSubsetStrategy("onethird"),
        BOOSTED: Boosted(labelCol=label, maxIter=n_trees, maxDepth=3, seed=V.SEED),
    }


def train_forest(train: DataFrame, numeric: Sequence[str], target: str, categorical: Sequence[str] = (),
                 n_trees: int = 100, depth: int = 12) -> PipelineModel:
    with held(spread(as_doubles(train.select(*numeric, *categorical, target), numeric))) as rows:
        stages = preprocessing_stages(numeric, most_frequent(rows, categorical))
        return Pipeline(stages=[*stages, forest(n_trees, depth, label=target)]).fit(rows)


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the feature vector's slots: numeric columns, then ``<column>_<label>`` per category."""
    names = []
    for stage in model.stages:
        if isinstance(stage, VectorAssembler) and stage.getOutputCol() == "numeric_raw":
            names += [c.removesuffix("_filled") for c in stage.getInputCols()]
        elif isinstance(stage, StringIndexerModel):
            # the encoder's slot behind the labels is for categories that training did not see
            names += [f"{stage.getInputCol().removesuffix('_known')}_{x}" for x in [*stage.labels, "unknown"]]
    return names


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance, method) of a fitted tree pipeline, by column name."""
    values = model.stages[-1].featureImportances.toArray()
    names = feature_names(model)
    if len(names) != len(values):
        raise ValueError(f"{len(values)} importances for {len(names)} feature names")
    rows = [(n, float(v), "built_in_importance") for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double, method string")


def top_importances(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def local_contributions(rows: DataFrame, table: DataFrame, columns: Sequence[str], ordinal: str) -> DataFrame:
    """Per row of ``rows`` and feature: value, contribution and the method that gave it.

    The contribution is the feature's share of the global importance, the same for every row: exact tree
    attributions are not built. One importance per column, so the table is a literal in the plan.
    """
    total = table.agg(F.sum("importance").alias("t")).scalar()
    share = table.select("feature", F.when(total > 0, F.col("importance") / total).otherwise(
        F.col("importance")).alias("contribution"), F.lit("global_importance").alias("method"))
    values = rows.select(ordinal, *[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot([ordinal], list(columns), "feature", "feature_value")
    return long.join(F.broadcast(share), "feature")         # one row per encoded column


# what an estimator raises for an input it cannot fit; anything else is a failure of the run
_UNFIT = (ValueError, AnalysisException, IllegalArgumentException)


def compare_models(train: DataFrame, validation: DataFrame, numeric: Sequence[str], target: str,
                   models: dict[str, object] | None = None) -> DataFrame:
    """Fit each model on train and measure it on validation (an action).

    A model that cannot take the input has null metrics and the reason in ``error``; other errors are raised.
    """
    prep = fit_preprocessing(train, numeric)

    def ready(df: DataFrame) -> DataFrame:
        return prep.transform(as_doubles(spread(df.select(*numeric, target)), numeric)).select(
            "features", F.col(target).cast("double").alias("label"))

    rows = []
    with held(ready(train)) as fit_on, held(ready(validation)) as judge_on:
        for name, model in (models or regressors()).items():
            rows.append((name, *_measured(model, fit_on, judge_on)))
    return train.sparkSession.createDataFrame(rows, "model string, rmse double, mae double, r2 double, error string")


def _measured(model, fit_on: DataFrame, judge_on: DataFrame) -> tuple:
    """(rmse, mae, r2, error) of a model fitted on one frame of (features, label) and judged on another."""
    try:
        scored = model.fit(fit_on).transform(judge_on).withColumnsRenamed({"label": "actual", "prediction": "predicted"})
        got = regression_metrics(scored).first()
        return got["rmse"], got["mae"], got["r2"], None
    except _UNFIT as e:
        return None, None, None, str(e).split("\n")[0]


def with_folds(df: DataFrame, row_id: str, k: int = 5, seed: int = V.SEED) -> DataFrame:
    """Deterministic fold number per row, without a shuffle."""
    digest = F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int"))


@dataclass(frozen=True)
class Moments:
    """Rows, known values, their mean and sum of squared deviations."""

    rows: int = 0
    known: int = 0
    mean: float = 0.0
    squares: float = 0.0

    def __add__(self, other: Moments) -> Moments:
        n = self.known + other.known
        apart = other.mean - self.mean
        return Moments(self.rows + other.rows, n, self.mean + apart * other.known / n if n else 0.0,
                       self.squares + other.squares + (apart * apart * self.known * other.known / n if n else 0.0))

    @property
    def deviation(self) -> float:
        """Sample deviation of the column once its nulls are the mean."""
        return (self.squares / (self.rows - 1)) ** 0.5 if self.rows > 1 else 0.0


def fold_moments(folded: DataFrame, columns: Sequence[str]) -> dict[int, dict[str, Moments]]:
    """Moments per fold and column from one scan (an action; one row per fold)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    found = folded.groupBy("fold").agg(*aggs).collect()
    return {r["fold"]: {c: Moments(r["rows"], r[f"n{i}"], r[f"m{i}"] or 0.0, (r[f"v{i}"] or 0.0) * r[f"n{i}"]) for i, c in enumerate(columns)} for r in found}


def training_moments(per_fold: dict[int, dict[str, Moments]], fold: int, columns: Sequence[str]) -> dict[str, Moments]:
    """What all folds but one hold together."""
    return {c: sum((m[c] for f, m in sorted(per_fold.items()) if f != fold), Moments()) for c in columns}


def standardised(df: DataFrame, moments: dict[str, Moments], target: str) -> DataFrame:
    """(features, label): nulls are the mean, every column is centred and scaled; one without spread is 0."""
    def scaled(c: str, m: Moments) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | F.lit(m.deviation == 0), F.lit(0.0)).otherwise((x - F.lit(m.mean)) / F.lit(m.deviation or 1.0))

    return df.select(array_to_vector(F.array(*[scaled(c, m) for c, m in moments.items()])).alias("features"), F.col(target).cast("double").alias("label"))


def cross_validate(df: DataFrame, numeric: Sequence[str], target: str, row_id: str, k: int = 5,
                   models: dict[str, object] | None = None, parallelism: int = 4) -> DataFrame:
    """Per model and fold rmse, mae and r2, preprocessing fitted inside each fold; failures are infinite.

    One scan gives the moments of all folds, from which each fold's training moments are added up; models and
    folds are fitted ``parallelism`` at a time (actions).
    """
    spark = df.sparkSession
    models = models or regressors()
    with held(spread(with_folds(df, row_id, k).select("fold", *numeric, target))) as folded:
        per_fold = fold_moments(folded, numeric)
        sides = {}
        for fold in range(k):
            moments = training_moments(per_fold, fold, numeric)
            sides[fold] = [standardised(folded.where(F.col("fold") != fold), moments, target).persist(StorageLevel.MEMORY_AND_DISK),
                           standardised(folded.where(F.col("fold") == fold), moments, target).persist(StorageLevel.MEMORY_AND_DISK)]
        try:
            work = [(name, fold) for fold in range(k) for name in models]
            with ThreadPool(min(parallelism, len(work))) as pool:
                got = pool.map(inheritable_thread_target(spark)(lambda w: (*w, *_measured(models[w[0]].copy(), *sides[w[1]]))), work, 1)
        finally:
            for frame in (f for pair in sides.values() for f in pair):
                frame.unpersist()
    inf = float("inf")
    rows = [(name, fold + 1, error, *(a if a is not None else b for a, b in zip(metrics, (inf, inf, -inf)))) for name, fold, *metrics, error in got]
    return spark.createDataFrame(rows, "model string, fold int, error string, rmse double, mae double, r2 double")


def tuning_grids(size: str = "expanded", label: str = "label") -> dict[str, tuple[object, list]]:
    """Parameter grids by name: ``compact`` for a quick search, ``expanded`` for a full one."""
    if size not in ("compact", "expanded"):
        raise ValueError(f"unknown grid: {size}")
    rf, gbt = forest(label=label), Boosted(labelCol=label, seed=V.SEED)
    extra = forest(label=label).setBootstrap(False)
    small = size == "compact"

    def trees(est):
        grid = ParamGridBuilder().addGrid(est.numTrees, [10, 50] if small else [10, 50, 100])
        grid = grid.addGrid(est.maxDepth, [3, 5, 15] if small else [3, 5, 10, 15])
        if not small:
            grid = grid.addGrid(est.minInstancesPerNode, [1, 2]).addGrid(
                est.featureSubsetStrategy, ["sqrt", "log2", "all"])
        return grid.build()

    boost = ParamGridBuilder().addGrid(gbt.maxIter, [10, 50] if small else [10, 50, 100])
    boost = boost.addGrid(gbt.stepSize, [0.01, 0.1] if small else [0.01, 0.1, 0.2])
    boost = boost.addGrid(gbt.maxDepth, [3, 5] if small else [3, 5, 7])
    if not small:
        boost = boost.addGrid(gbt.minInstancesPerNode, [1, 2]).addGrid(
            gbt.featureSubsetStrategy, ["sqrt", "log2", "all"])
    return {FOREST: (rf, trees(rf)), EXTRA: (extra, trees(extra)), BOOSTED: (gbt, boost.build())}


def tune_models(frame: DataFrame, grids: dict[str, tuple[object, list]], folds: int = 3,
                parallelism: int = 4) -> DataFrame:
    """Best cross-validated rmse per model, the winning parameters and the points searched (an action).

    ``frame``: features, label. A model that cannot take the input has an infinite rmse and an ``error``.
    """
    rows = []
    with held(frame):
        for name, (est, grid) in grids.items():
            try:
                cv = CrossValidator(estimator=est, estimatorParamMaps=grid, numFolds=folds, parallelism=parallelism,
                                    evaluator=RegressionEvaluator(metricName="rmse"), seed=V.SEED).fit(frame)
                best = min(range(len(grid)), key=lambda i: cv.avgMetrics[i])
                chosen = {p.name: v for p, v in grid[best].items()}
                rows.append((name, float(cv.avgMetrics[best]), str(dict(sorted(chosen.items()))), len(cv.avgMetrics), None))
            except _UNFIT as e:
                rows.append((name, float("inf"), "{}", 0, str(e).split("\n")[0]))
    return frame.sparkSession.createDataFrame(
        rows, "model string, best_rmse double, best_params string, n_points long, error string")


def score(model: PipelineModel, df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Score a table with the imputation fitted in training."""
    helpers = ("_filled", "_known", "_index", "_hot")
    scored = model.transform(as_doubles(spread(df, 3), numeric)).withColumnRenamed("prediction", "predicted")
    drop = [c for c in scored.columns if c.endswith(helpers) or c in ("numeric_raw", "numeric_scaled", "features")]
    return scored.drop(*drop)
