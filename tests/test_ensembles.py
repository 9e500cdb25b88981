"""The search over tree ensembles against fits of single points."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import ensembles as E


def table(n, d=4, seed=1):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, E.BINS, (n, d)).astype(np.uint8)
    return codes, codes[:, 0] / 10.0 + (codes[:, 1] > 30) * codes[:, 2] / 20.0 + rng.normal(0, 0.1, n)


@pytest.mark.parametrize("model", [E.FOREST, E.EXTRA])
def test_a_cut_off_tree_is_the_tree_of_that_depth(model):
    codes, y = table(800)
    for depth in (0, 1, 3, 5):
        deep, flat = (E.grow(codes, y, np.ones(800), most, 2, 2, model == E.EXTRA, np.random.default_rng(7)) for most in (30, depth))
        assert np.array_equal(deep.read(codes, [depth]), flat.read(codes, [depth]))


def test_the_first_trees_and_steps_are_the_smaller_ensembles():
    codes, y = table(300)
    whole = E.Unit(3, E.FOREST, 0, 1, 2, 0, 4)
    parts = [E.Unit(3, E.FOREST, 0, 1, 2, first, 2) for first in (0, 2)]
    assert np.allclose(whole.predictions(codes, y, codes, [3, 30]), sum(u.predictions(codes, y, codes, [3, 30]) for u in parts))
    boosted = E.Unit(4, E.BOOSTED, 0, 1, 2, rate=0.1, depth=3)
    assert np.array_equal(boosted.predictions(codes, y, codes, [5, 20])[:, 0], boosted.predictions(codes, y, codes, [5])[:, 0])


def test_a_full_tree_splits_like_least_squares():
    codes, y = table(400)
    tree = E.grow(codes, y, np.ones(400), 1, 1, 4, False, np.random.default_rng(0))
    costs = {(f, c): sum(((y[s] - y[s].mean()) ** 2).sum() for s in (codes[:, f] <= c, codes[:, f] > c) if s.any()) for f in range(4) for c in range(E.BINS)}
    assert costs[int(tree.feature[0][0]), int(tree.cut[0][0])] == pytest.approx(min(costs.values()))
    deep = E.grow(codes, y, np.ones(400), 30, 1, 4, False, np.random.default_rng(0))
    distinct = len(np.unique(codes, axis=0))
    assert np.abs(deep.read(codes, [30])[:, 0] - y).max() < 1e-3 or distinct < 400
    assert len(E.grow(codes, np.ones(400), np.ones(400), 30, 1, 4, False, np.random.default_rng(0)).mean) == 1


def test_points_of_a_search(spark, monkeypatch):
    monkeypatch.setitem(E.GRIDS, "compact", E.Grid((2, 4), (None, 2), (2,), (0.3,), (1, 3), ("sqrt", "all")))
    monkeypatch.setattr(E, "TREES_OF_UNIT", 2)
    codes, y = table(240)
    rows = [(i, [float(c) for c in codes[i]], float(y[i])) for i in range(240)]
    frame = spark.createDataFrame(rows, "id long, features array<double>, label double").repartition(3)
    got = {(r["model"], r["trees"], r["depth"], r["leaf"], r["features"], r["rate"]): r["rmse"] for r in E.search(frame, "compact").collect()}
    assert len(got) == 2 * 2 * 2 * 2 * 2 + 2 * 2 * 2 and all(0 < v < y.std() for v in got.values())
    best = {r["model"]: r for r in E.best_points(E.search(frame, "compact")).collect()}
    assert {m: r["n_points"] for m, r in best.items()} == {E.FOREST: 16, E.EXTRA: 16, E.BOOSTED: 8}
    assert all(r["best_rmse"] == pytest.approx(min(v for k, v in got.items() if k[0] == m)) for m, r in best.items())


def test_grid_by_rows_and_resolved_features(spark):
    assert (E.resolved("sqrt", 6), E.resolved("log2", 6), E.resolved("all", 6), E.resolved("log2", 1)) == (2, 2, 6, 1)
    points = E.units(E.GRIDS["expanded"], 6, 3)
    assert sum(u.trees for u in points) == 3 * 2 * 2 * 2 * 100 and sum(u.model == E.BOOSTED for u in points) == 3 * 9 * 2 * 2
    with pytest.raises(ValueError):
        E.search(spark.range(1).select("id", F.array(F.lit(1.0)).alias("features"), F.lit(1.0).alias("label")))
