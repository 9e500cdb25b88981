"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Cyclic boosting visits one feature after another and adds a
shallow tree on its bins, so the sum of all trees of a feature is one lookup table; pairs that still
explain something get a table over coarse bins in the same way. A score is an intercept plus one table
entry per feature and pair. Defined results: null and empty texts have all statistics zero and are
scored like any text; without both labels in the sample every score is the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aeroframe.llm import common, textstats

MAX_TRAINING_ROWS = 20_000


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of table entries per row."""
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, j])]
        binned = {j: np.searchsorted(self.coarse[j], x[:, j]) for p in self.pairs for j in p}
        for (i, j), t in self.pairs.items():
            out += t[binned[i], binned[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin borders: midpoints between distinct values, thinned by quantile."""
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)))
    return (q[1:] + q[:-1]) / 2


def _split(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of consecutive bins."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - cg, h.sum() - ch
    gain = np.where((ch >= least) & (rh >= least), cg ** 2 / (ch + ridge) + rg ** 2 / (rh + ridge), -1.0)
    if not len(gain):
        return -1.0, 0
    k = int(np.argmax(gain))
    return float(gain[k] - g.sum() ** 2 / (h.sum() + ridge)), k + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """Leaf value per bin of a tree with ``depth`` levels of cuts."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        gain, k = _split(g, h, least, ridge)
        if gain > 1e-9:
            out[:k] = _shallow_tree(g[:k], h[:k], depth - 1, least, ridge)
            out[k:] = _shallow_tree(g[k:], h[k:], depth - 1, least, ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """One cut of the rows of a grid, then one of the columns in each half; gain and cell values."""
    best, out = 0.0, np.zeros_like(g)
    total = g.sum() ** 2 / (h.sum() + ridge)
    for k in range(1, len(g)):
        cells, score = np.zeros_like(g), 0.0
        for part in (slice(0, k), slice(k, None)):
            a, b = g[part].sum(0), h[part].sum(0)
            values = _shallow_tree(a, b, 1, least, ridge)
            cells[part] = values
            score += float((2 * values * a - values ** 2 * b).sum())
        if score - total > best:
            best, out = score - total, cells
    return best, out


def learn(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 60,
          n_pairs: int = 8, rate: float = 0.15, least: float = 2.0, ridge: float = 1.0) -> Model:
    """Cyclic boosting with Newton steps on the logistic loss."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], bins) if n else np.zeros(0) for j in range(m)]
    coarse = [_edges(x[:, j], coarse_bins) if n else np.zeros(0) for j in range(m)]
    model = Model(start, edges, [np.zeros(len(e) + 1) for e in edges], coarse, {})
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]
    raw = np.full(n, start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(m):
            g, h = slopes()
            size = len(edges[j]) + 1
            step = rate * _shallow_tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), 2, least, ridge)
            model.tables[j] += step
            raw += step[at[j]]
    spots = [np.searchsorted(e, x[:, j]) for j, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        rows, columns = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(spots[i] * columns + spots[j], v, rows * columns).reshape(rows, columns)

    g, h = slopes()
    ranked = sorted(((-_pair_tree(grid(i, j, g), grid(i, j, h), least, ridge)[0], i, j) for i, j in combinations(range(m), 2)))
    chosen = [(i, j) for gain, i, j in ranked[:n_pairs] if gain < 0]
    model.pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), least, ridge)[1]
            model.pairs[i, j] += step
            raw += step[spots[i], spots[j]]
    return model


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learn from at most ``max_rows`` labelled documents; only their statistics reach the driver."""
    rows = common.labelled(documents, labels, label, max_rows)
    measured = rows.select("doc_id", "label", textstats.statistics("text").alias("s"))
    got = measured.select("doc_id", "label", *[F.col("s")[f].alias(f) for f in textstats.FEATURES]).toPandas()
    got = got.sort_values(["doc_id", *textstats.FEATURES], kind="stable")
    x = got[list(textstats.FEATURES)].to_numpy(float).reshape(-1, len(textstats.FEATURES))
    return learn(x, (got["label"].to_numpy() == 1).astype(float))


def scored(model: Model, text: Column | str) -> Column:
    """Score (0 to 1) of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(textstats.features(textstats._count_rows(texts))))

    return score.asNondeterministic()(text)
