"""Column profiles, correlations and feature ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroframe import values as V
from aeroframe.operators.columns import numeric_columns
from aeroframe.operators.orderstat import exact_quantiles, wide_quantiles
from aeroframe.operators.quality import null_percentages
from aeroframe.operators.sizes import attach_row


def _long(one: DataFrame, names: Sequence[str], metrics: dict[str, str], key: str = "column_name") -> DataFrame:
    """One wide row to one row per name; cell columns are called ``<metric>|<name>``."""
    cells = F.array(*[
        F.struct(F.lit(n).alias(key), *[F.col(f"`{m}|{n}`").cast(t).alias(m) for m, t in metrics.items()])
        for n in names])
    return one.select(F.explode(cells).alias("_c")).select("_c.*")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null share (2 decimals) of each column with its dictionary entry."""
    entries = [(c, d, u, s) for c, d, u, s in V.FEATURE_DICTIONARY]
    dictionary = df.sparkSession.createDataFrame(entries, "column_name string, description string, unit string, source string")
    return null_percentages(df, columns, 2).join(F.broadcast(dictionary), "column_name", "left")


def feature_summary(df: DataFrame, station: str = "station_id") -> DataFrame:
    per_station = df.groupBy(station).agg(F.count(F.lit(1)).alias("n"))
    return per_station.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(station).alias("n_stations"),
                           F.lit(len(df.columns)).cast("long").alias("n_columns"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column (exact quartiles)."""
    metrics = {"n": "long", "mean": "double", "std": "double", "min": "double", "max": "double"}
    one = df.agg(*[e.alias(f"{m}|{c}") for c in columns for m, e in {
        "n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}.items()])
    stats = _long(one, columns, metrics)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column_name").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n)
        for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return stats.join(F.broadcast(quartiles), "column_name", "left")     # one row per column


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, distinct values, most frequent value (smallest on a tie) and its frequency."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    counts = df.select(pairs.alias("_p")).select("_p.*").where("v is not null").groupBy("column_name", "v").agg(
        F.count(F.lit(1)).alias("k"))
    top = F.min(F.struct((-F.col("k")).alias("k"), F.col("v").alias("v")))
    return counts.groupBy("column_name").agg(
        F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_unique"), top.alias("_t")).select(
        "column_name", "n", "n_unique", F.col("_t.v").alias("top"), (-F.col("_t.k")).alias("freq"))


def dataset_summary(df: DataFrame, target: str) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"_{c}") for c in df.columns])
    nulls = sum((F.col("n_rows") - F.col(f"_{c}")) for c in df.columns)
    return one.select("n_rows", F.lit(len(df.columns) - 1).cast("long").alias("n_features"),
                      F.lit(target).alias("target"), nulls.alias("n_null_cells"))


def variances(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    one = df.agg(*[F.var_samp(c).alias(f"variance|{c}") for c in columns])
    return _long(one, columns, {"variance": "double"}).withColumn(
        "dropped", F.coalesce(F.col("variance") <= threshold, F.lit(True)))


def _pearson(cov: Column, dev_a: Column, dev_b: Column) -> Column:
    """Null where a side does not vary."""
    return F.try_divide(cov, dev_a * dev_b)


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r of each pair from one aggregate; rows where a side is null do not count for the pair."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"x{i}"), F.stddev_pop(y).alias(f"y{i}")]
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                               _pearson(F.col(f"c{i}"), F.col(f"x{i}"), F.col(f"y{i}")).alias("r"))
                      for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("_c")).select("_c.*")


def _filled_moments(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """After mean fill: covariance of each pair, deviation of each column and whether it varies.

    The means are known first, so every moment is a plain mean of products of centred values.
    """
    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    with_means = attach_row(narrow, narrow.agg(*[F.avg(c).alias(c) for c in columns]), "_means")
    centred = with_means.select(*[F.coalesce(F.col(c) - F.col(f"_means.{c}"), F.lit(0.0)).alias(c) for c in columns])
    return centred.agg(
        *[F.avg(F.col(a) * F.col(b)).alias(f"c|{a}|{b}") for a, b in pairs],
        *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"s|{c}") for c in columns],
        *[(F.max(c) > F.min(c)).alias(f"v|{c}") for c in columns])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long Pearson matrix after mean fill; columns without variance are left out."""
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = _filled_moments(df, columns, upper)
    s = {c: F.col(f"`s|{c}`") for c in columns}
    r = {(a, b): _pearson(F.col(f"`c|{a}|{b}`"), s[a], s[b]) for a, b in upper}
    r.update({(b, a): x for (a, b), x in list(r.items())})
    cells = F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), r[(a, b)].alias("r"),
                 (F.col(f"`v|{a}`") & F.col(f"`v|{b}`")).alias("_ok")) for a in columns for b in columns])
    return one.select(F.explode(cells).alias("_c")).select("_c.*").where("_ok").drop("_ok")


def target_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """r of every feature that varies with the target, both mean-filled."""
    if target not in df.columns or target not in numeric_columns(df):
        raise ValueError(f"target {target} must be a numeric column")
    used = list(dict.fromkeys([*columns, target]))
    one = _filled_moments(df, used, [(c, target) for c in columns])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 _pearson(F.col(f"`c|{c}|{target}`"), F.col(f"`s|{c}`"), F.col(f"`s|{target}`")).alias("r"),
                 F.col(f"`v|{c}`").alias("_v")) for c in columns])
    return one.select(F.explode(cells).alias("_c")).select("_c.*").where("_v").drop("_v")


def rank_features(ranked: DataFrame, feature: str = "feature", r: str = "r",
                  importance: str = "importance") -> DataFrame:
    """Ranks by |r| and by importance, their mean and the final rank. One row per feature."""
    by = lambda *o: Window.partitionBy(F.lit(0)).orderBy(*o)
    out = ranked.select(feature, F.col(r).alias("r"), F.abs(F.col(r)).alias("abs_r"),
                        F.coalesce(F.col(importance), F.lit(0.0)).alias("importance"))
    out = out.withColumns({"r_rank": F.rank().over(by(F.col("abs_r").desc())),
                           "importance_rank": F.rank().over(by(F.col("importance").desc()))})
    out = out.withColumn("combined", (F.col("r_rank") + F.col("importance_rank")) / 2.0)
    return out.withColumn("final_rank", F.rank().over(by("combined")))


def collinear_pairs(matrix: DataFrame, ranking: DataFrame, threshold: float = 0.8,
                    feature: str = "feature") -> DataFrame:
    """Pairs with |r| at or above the threshold and which one to keep (better rank; first on a tie)."""
    rank_of = ranking.select(F.col(feature).alias("f"), F.col("final_rank").alias("k"))
    pairs = matrix.where((F.abs("r") >= threshold) & (F.col("feature_a") < F.col("feature_b")))
    a = rank_of.withColumnsRenamed({"f": "feature_a", "k": "rank_a"})
    b = rank_of.withColumnsRenamed({"f": "feature_b", "k": "rank_b"})
    keep_a = F.col("rank_a") <= F.col("rank_b")
    return pairs.join(a, "feature_a").join(b, "feature_b").select(
        "feature_a", "feature_b", "r", "rank_a", "rank_b",
        F.when(keep_a, F.col("feature_a")).otherwise(F.col("feature_b")).alias("keep"),
        F.when(keep_a, F.col("feature_b")).otherwise(F.col("feature_a")).alias("drop"))


def collect_collinear_drops(df: DataFrame, columns: Sequence[str], target: str | None = None,
                            threshold: float = 0.95) -> list[str]:
    """Greedy pruning in column order (an action: collects the small matrix).

    Of two columns with |r| at or above the threshold the one less correlated with the target goes;
    the second goes on a tie or without a target.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not pairs:
        return []
    asked = pairs + ([(c, target) for c in columns] if target else [])
    r = {(x.feature_a, x.feature_b): abs(x.r) for x in correlations(df, asked).collect() if x.r is not None}
    dropped: list[str] = []
    for a, b in pairs:
        if a in dropped or b in dropped or r.get((a, b), 0.0) < threshold:
            continue
        loses = a if target and r.get((a, target), 0.0) < r.get((b, target), 0.0) else b
        dropped.append(loses)
    return dropped


def training_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column that has a value."""
    return wide_quantiles(exact_quantiles(df, columns, [0.5]), columns, {0.5: "median"})


def prepared_features(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Training rows with median-filled features; all-null columns are gone (an action decides which)."""
    rows = df.where(F.col(target).isNotNull())
    known = rows.agg(*[F.count(c).alias(c) for c in columns]).collect()[0]
    kept = [c for c in columns if known[c] > 0]
    held = attach_row(rows, training_medians(rows, kept), "_medians")
    return held.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_medians.{c}_median")) for c in kept}).select(
        *[c for c in df.columns if c not in columns or c in kept])
