"""Parameter search over tree ensembles: many points from few fits, grown side by side in Spark tasks.

A forest of 100 trees without a depth limit holds every smaller forest of its kind: the first 10 or 50 trees, each
read down to depth 3, 5 or 10 only. A boosted ensemble is read after 10, 50 and 100 steps. Points whose number of
features per node comes out the same are one fit. So 306 points need 8 forests and 36 boosted ensembles per fold.

Spark deals every unit of work (ten trees of a forest, or one boosted ensemble) its training rows and the rows of
its fold that judge it; a unit gets a sample of about ``ROWS`` rows of each where there are more, so no task holds
more. Trees split on up to 64 quantile bins. Predictions come back per judged row and meet in grouped aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aeroframe import values as V

FOREST, EXTRA, BOOSTED = "Random Forest Regressor", "Extra Trees Regressor", "Gradient Boosting Regressor"
ROWS = 20_000                    # expected training and judging rows of a unit, at most
BINS = 64
DEEPEST = 30                     # depth of trees without a limit
TREES_OF_UNIT = 10
EXPANDED_FROM = 100              # rows from which the expanded grid is searched


@dataclass(frozen=True)
class Grid:
    """Values per parameter; a depth of None is no limit."""

    trees: tuple[int, ...]
    depths: tuple[int | None, ...]
    boosted_depths: tuple[int, ...]
    rates: tuple[float, ...]
    leaves: tuple[int, ...] = (1,)
    features: tuple[str, ...] = ("all",)


GRIDS = {
    "compact": Grid((10, 50), (None, 3, 5), (3, 5), (0.01, 0.1)),
    "expanded": Grid((10, 50, 100), (None, 3, 5, 10), (3, 5, 7), (0.01, 0.1, 0.2), (1, 2), ("sqrt", "log2", "all")),
}


def resolved(features: str, d: int) -> int:
    """Features looked at per node."""
    n = {"sqrt": math.isqrt(d), "log2": int(math.log2(d)) if d else 1, "all": d}[features]
    return max(1, n)


@dataclass
class Tree:
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    child: list[np.ndarray] = field(default_factory=list)      # left child in the next level, -1 for a leaf
    mean: list[np.ndarray] = field(default_factory=list)

    def read(self, codes: np.ndarray, depths: Sequence[int]) -> np.ndarray:
        """Predictions (rows x depths) of the tree cut off at each depth."""
        out = np.empty((len(codes), len(depths)))
        rows, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        value = self.mean[0][node]
        for level in range(len(self.mean)):
            value[rows] = self.mean[level][node]
            for i, depth in enumerate(depths):
                if depth == level:
                    out[:, i] = value
            on = self.child[level][node] >= 0
            rows, node = rows[on], node[on]
            right = codes[rows, self.feature[level][node]] > self.cut[level][node]
            node = self.child[level][node] + right
        for i, depth in enumerate(depths):
            if depth >= len(self.mean):
                out[:, i] = value
        return out


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, leaf: int, features: int, random_cuts: bool,
         rng: np.random.Generator) -> Tree:
    """A regression tree, level by level: all nodes of a level share one histogram per feature."""
    tree, d = Tree(), codes.shape[1]
    used = np.flatnonzero(weight)
    codes, y, weight = codes[used], y[used], weight[used].astype(float)
    node, nodes = np.zeros(len(y), np.int64), 1
    for level in range(depth + 1):
        n, s = np.bincount(node, weight, nodes), np.bincount(node, weight * y, nodes)
        tree.mean.append(s / np.maximum(n, 1))
        best, feature, cut = s * s / np.maximum(n, 1) + 1e-9 * (1 + np.abs(s)), np.full(nodes, -1), np.zeros(nodes, np.int64)
        open_ = np.flatnonzero(n >= max(2, 2 * leaf)) if level < depth else np.zeros(0, np.int64)
        if len(open_):
            m = len(open_)
            place = np.full(nodes, -1)
            place[open_] = np.arange(m)
            rows = np.flatnonzero(place[node] >= 0)
            cells, w, wy, n, s = place[node[rows]] * BINS, weight[rows], (weight * y)[rows], n[open_], s[open_]
            looked = rng.random((m, d)).argsort(1).argsort(1) < features
            for f in range(d):
                cell = cells + codes[rows, f]
                in_cell = np.bincount(cell, w, m * BINS).reshape(m, BINS)
                left = in_cell.cumsum(1)
                left_s = np.bincount(cell, wy, m * BINS).reshape(m, BINS).cumsum(1)
                if random_cuts:
                    low, high = (in_cell > 0).argmax(1), BINS - 1 - (in_cell[:, ::-1] > 0).argmax(1)
                    at = low + (rng.random(m) * np.maximum(high - low, 1)).astype(np.int64)
                    left, left_s = left[np.arange(m), at][:, None], left_s[np.arange(m), at][:, None]
                right, right_s = n[:, None] - left, s[:, None] - left_s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((left >= leaf) & (right >= leaf), left_s ** 2 / left + right_s ** 2 / right, -np.inf)
                if not random_cuts:
                    at = gain.argmax(1)
                found = np.where(looked[:, f], gain[:, 0] if random_cuts else gain[np.arange(m), at], -np.inf)
                better = found > best[open_]
                which = open_[better]
                best[which], feature[which], cut[which] = found[better], f, at[better]
        split = feature >= 0
        child = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        tree.feature.append(feature)
        tree.cut.append(cut)
        tree.child.append(child)
        if not split.any():
            break
        on = split[node]
        codes, y, weight, node = codes[on], y[on], weight[on], node[on]
        node = child[node] + (codes[np.arange(len(node)), feature[node]] > cut[node])
        nodes = 2 * int(split.sum())
    return tree


@dataclass(frozen=True)
class Unit:
    """Work of one task; trees are counted from ``first``."""

    number: int
    model: str
    fold: int
    leaf: int
    features: int
    first: int = 0
    trees: int = 0
    rate: float = 0.0
    depth: int = 0

    def predictions(self, codes: np.ndarray, y: np.ndarray, judged: np.ndarray, stops: Sequence[int]) -> np.ndarray:
        """Judged rows x stops: sums over the trees at each depth, or the ensemble after each number of steps."""
        out = np.zeros((len(judged), len(stops)))
        if not len(y):
            return out
        if self.model == BOOSTED:
            rng = np.random.default_rng([V.SEED, self.number])
            now, seen = np.full(len(y), y.mean()), np.full(len(judged), y.mean())
            for step in range(1, max(stops) + 1):
                tree = grow(codes, y - now, np.ones(len(y)), self.depth, self.leaf, self.features, False, rng)
                now += self.rate * tree.read(codes, [self.depth])[:, 0]
                seen += self.rate * tree.read(judged, [self.depth])[:, 0]
                for i, stop in enumerate(stops):
                    if stop == step:
                        out[:, i] = seen
            return out
        for k in range(self.first, self.first + self.trees):
            rng = np.random.default_rng([V.SEED, self.number, k])
            weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) if self.model == FOREST else np.ones(len(y))
            tree = grow(codes, y, weight, max(stops), self.leaf, self.features, self.model == EXTRA, rng)
            out += tree.read(judged, stops)
        return out


def units(grid: Grid, d: int, folds: int) -> list[Unit]:
    out: list[Unit] = []
    widths = sorted({resolved(f, d) for f in grid.features})
    for fold, leaf, k in product(range(folds), grid.leaves, widths):
        for model, first in product((FOREST, EXTRA), range(0, max(grid.trees), TREES_OF_UNIT)):
            out.append(Unit(len(out), model, fold, leaf, k, first, min(TREES_OF_UNIT, max(grid.trees) - first)))
        for rate, depth in product(grid.rates, grid.boosted_depths):
            out.append(Unit(len(out), BOOSTED, fold, leaf, k, rate=rate, depth=depth))
    return out


def _dealt(rows: DataFrame, todo: list[Unit], cuts: list[list[float]], shares: dict[int, float], own: dict[int, float]) -> DataFrame:
    """(unit, part, codes, label, judged): per batch of rows what every unit needs of it."""
    edges = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(ids), -1)
            y = batch.column(3).to_numpy()
            codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8)
            for u in todo:
                chance = np.random.default_rng([V.SEED, u.number, part]).random(len(ids))
                judged = fold == u.fold
                take = np.flatnonzero(chance < np.where(judged, own[u.fold], shares[u.fold]))
                columns = ([u.number], [part], *([a[take].tobytes()] for a in (codes, y, judged, ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                                                 names=["unit", "part", "codes", "label", "judged", "ids"])
            part += 1

    return rows.select("id", "fold", "x", "label").mapInArrow(run, "unit int, part long, codes binary, label binary, judged binary, ids binary")


def search(frame: DataFrame, size: str | None = None, folds: int = 3) -> DataFrame:
    """Cross-validated rmse of every point (model, trees, depth, leaf, features, rate, rmse); actions.

    ``frame``: id (long, unique), features (array of doubles without nulls), label. The grid is the compact one
    below EXPANDED_FROM rows, else the expanded one, if no ``size`` is named.
    """
    spark = frame.sparkSession
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(V.SEED))).cast("binary"))
    fold = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")
    rows = frame.select(F.col("id").cast("long").alias("id"), fold.alias("fold"), F.col("features").alias("x"), F.col("label").cast("double").alias("label"))
    counts = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if n < 2:
        raise ValueError(f"a search needs two rows, found {n}")
    d = rows.select(F.size("x")).first()[0]
    probabilities = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), probabilities, 10_000).alias(f"f{f}") for f in range(d)]).first()
    cuts = [sorted(set(found[f"f{f}"])) for f in range(d)]
    grid = GRIDS[size or ("compact" if n < EXPANDED_FROM else "expanded")]
    todo = units(grid, d, folds)
    own = {f: min(1.0, ROWS / max(counts.get(f, 0), 1)) for f in range(folds)}
    shares = {f: min(1.0, ROWS / max(n - counts.get(f, 0), 1)) for f in range(folds)}
    depths = [DEEPEST if x is None else x for x in grid.depths]

    def judged_by(key: tuple, table: pa.Table) -> pa.Table:
        unit = todo[key[0].as_py()]
        order = np.argsort(table["part"].to_numpy(), kind="stable")
        codes, y, judged, ids = (np.concatenate([np.frombuffer(table[c][int(i)].as_buffer(), t) for i in order])
                                 for c, t in (("codes", np.uint8), ("label", np.float64), ("judged", bool), ("ids", np.int64)))
        codes = codes.reshape(len(y), -1)
        got = unit.predictions(codes[~judged], y[~judged], codes[judged], grid.trees if unit.model == BOOSTED else depths)
        return pa.table({"unit": pa.array([unit.number] * int(judged.sum()), pa.int32()), "id": ids[judged], "label": y[judged],
                         "got": pa.array(list(got), pa.list_(pa.float64()))})

    dealt = _dealt(rows, todo, cuts, shares, own).repartition(len(todo), "unit")
    scored = dealt.groupBy("unit").applyInArrow(judged_by, "unit int, id long, label double, got array<double>")
    # one row per unit of the grid
    known = spark.createDataFrame([(u.number, u.model, u.fold, u.leaf, u.features, u.first, u.rate, u.depth) for u in todo],
                                  "unit int, model string, fold int, leaf int, width int, first int, rate double, depth int")
    scored = scored.join(F.broadcast(known), "unit")
    squares = []
    for t, trees in enumerate(grid.trees):
        for i, depth in enumerate(grid.depths):
            summed = F.sum(F.when(F.col("first") < trees, F.get("got", F.lit(i))))
            squares.append(F.struct(F.lit(trees).alias("trees"), F.lit(depth).cast("int").alias("depth"), F.pow(summed / trees - F.first("label"), F.lit(2)).alias("e")))
    kind = ["model", "fold", "leaf", "width"]
    of_forests = scored.where(F.col("model") != BOOSTED).groupBy(*kind, "id").agg(F.array(*squares).alias("e"))
    of_forests = of_forests.select(*kind, F.lit(None).cast("double").alias("rate"), F.explode("e").alias("e")).select(*kind, "rate", "e.trees", "e.depth", "e.e")
    stops = F.array(*[F.struct(F.lit(t).alias("trees"), F.pow(F.get("got", F.lit(i)) - F.col("label"), F.lit(2)).alias("e")) for i, t in enumerate(grid.trees)])
    of_boosted = scored.where(F.col("model") == BOOSTED).select(*kind, "rate", "depth", F.explode(stops).alias("e")).select(*kind, "rate", "e.trees", "depth", "e.e")
    point = ["model", "leaf", "width", "rate", "trees", "depth"]
    errors = of_forests.unionByName(of_boosted).groupBy(*point, "fold").agg(F.sqrt(F.avg("e")).alias("rmse")).groupBy(*point).agg(F.avg("rmse").alias("rmse"))
    names = spark.createDataFrame([(f, resolved(f, d)) for f in grid.features], "features string, width int")
    return errors.join(F.broadcast(names), "width").select("model", "trees", "depth", "leaf", "features", "rate", "rmse")


def best_points(points: DataFrame) -> DataFrame:
    """Per model: best_rmse, best_params and the number of points searched."""
    shown = F.to_json(F.struct("trees", "depth", "leaf", "features", "rate"))
    return points.groupBy("model").agg(F.min("rmse").alias("best_rmse"), F.min(F.struct("rmse", shown.alias("p")))["p"].alias("best_params"),
                                       F.count(F.lit(1)).alias("n_points"))
