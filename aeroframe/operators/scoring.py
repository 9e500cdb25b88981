"""Regression metrics, model ranking and model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroframe import values as V


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def regression_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """r2, rmse, mae and mbe (mean of predicted minus actual)."""
    y, p = F.col(actual), F.col(predicted)
    err = p - y
    one = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("_mse"), F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("mbe"), F.var_pop(y).alias("_var"))
    r2 = F.when((F.col("n") >= 2) & (F.col("_var") > 0), 1 - F.col("_mse") / F.col("_var"))
    return one.select(*by, "n", r2.alias("r2"), F.sqrt("_mse").alias("rmse"), "mae", "mbe")


def with_residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    residual = F.col(actual) - F.col(predicted)
    return df.withColumns({"residual": residual, "abs_error": F.abs(residual), "squared_error": residual * residual})


def residual_summary(residuals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return residuals.groupBy(*by).agg(
        F.count("residual").alias("n"), F.avg("abs_error").alias("mae"), F.avg("squared_error").alias("mse"),
        F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("residual").alias("mean_residual"),
        F.coalesce(F.stddev_samp("residual"), F.lit(0.0)).alias("std_residual"))


def cv_summary(folds: DataFrame, model: str = "model", metrics: Sequence[str] = ("rmse", "mae", "r2")) -> DataFrame:
    """Mean and sample deviation per model; infinite scores count as missing."""
    aggs = []
    for m in metrics:
        x = _finite(F.col(m))
        aggs.append(F.avg(x).alias(f"{m}_mean"))
        spread = F.when(F.count(F.lit(1)) > 1, F.stddev_samp(x))
        aggs.append(F.when(F.count(x) == 0, F.lit(0.0)).when(F.count(F.lit(1)) == 1, F.lit(0.0))
                    .otherwise(spread).alias(f"{m}_std"))
    return folds.groupBy(model).agg(*aggs)


def prediction_summary(df: DataFrame, predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(predicted).alias("n"), F.avg(predicted).alias("mean"), F.min(predicted).alias("min"),
        F.max(predicted).alias("max"), F.coalesce(F.stddev_samp(predicted), F.lit(0.0)).alias("std"))


def _over(*order) -> Window:
    return Window.partitionBy(F.lit(0)).orderBy(*order)      # one row per model


def rank_models(results: DataFrame) -> DataFrame:
    """Rank by rmse and by r2 (missing last), mean rank, final rank."""
    filled = results.withColumns({
        "rmse": F.coalesce("rmse", F.lit(float("inf"))), "r2": F.coalesce("r2", F.lit(float("-inf")))})
    out = filled.withColumns({"rmse_rank": F.rank().over(_over(F.col("rmse"))),
                              "r2_rank": F.rank().over(_over(F.col("r2").desc()))})
    out = out.withColumn("combined", (F.col("rmse_rank") + F.col("r2_rank")) / 2.0)
    return out.withColumn("final_rank", F.rank().over(_over("combined")))


def rank_tuned(results: DataFrame) -> DataFrame:
    filled = results.withColumn("best_rmse", F.coalesce("best_rmse", F.lit(float("inf"))))
    return filled.withColumn("final_rank", F.rank().over(_over("best_rmse")))


def score_candidates(comparison: DataFrame | None, folds: DataFrame | None, tuned: DataFrame | None) -> DataFrame:
    """Weighted score over the finite metrics of each model; no finite metric ranks last.

    A model known only from cross-validation is ignored; an absent input counts as empty.
    """
    spark = next(d for d in (comparison, folds, tuned) if d is not None).sparkSession
    empty = lambda: spark.createDataFrame([], "model string, x double")
    base = comparison.groupBy("model").agg(F.first("rmse").alias("baseline")) if comparison is not None else \
        empty().select("model", F.col("x").alias("baseline"))
    cv = folds.groupBy("model").agg(F.avg(_finite(F.col("rmse"))).alias("cv")) if folds is not None else \
        empty().select("model", F.col("x").alias("cv"))
    opt = tuned.groupBy("model").agg(F.first("best_rmse").alias("optimized")) if tuned is not None else \
        empty().select("model", F.col("x").alias("optimized"))
    joined = base.join(opt, "model", "full_outer").join(cv, "model", "left")
    parts = {k: _finite(F.col(k)) for k in V.SCORE_WEIGHTS}
    used = {k: F.when(parts[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in V.SCORE_WEIGHTS.items()}
    total = sum(used.values())
    share = {k: F.when(total > 0, used[k] / total).otherwise(0.0) for k in used}
    score = F.when(total > 0, sum(F.coalesce(parts[k] * share[k], F.lit(0.0)) for k in parts))
    out = joined.select(
        "model", *[parts[k].alias(f"{k}_rmse") for k in parts], score.alias("score"),
        *[share[k].alias(f"{k}_weight") for k in share])
    order = F.coalesce("score", F.lit(float("inf")))
    return out.withColumn("final_rank", F.rank().over(_over(order)))


def select_model(scores: DataFrame) -> DataFrame:
    """The rank-one row (first by name on a tie)."""
    return scores.orderBy("final_rank", "model").limit(1)


def top_contributions(df: DataFrame, k: int = 10, by: Sequence[str] = (), feature: str = "feature",
                      value: str = "contribution") -> DataFrame:
    """Largest contributions by absolute value, with their direction."""
    order = [F.abs(F.col(value)).desc(), F.col(feature)]
    named = df.withColumn("direction", F.when(F.col(value) >= 0, "increase").otherwise("decrease"))
    if not by:
        return named.orderBy(*order).limit(k)
    ranked = named.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("place") <= k)
