"""Regression trees grown from histograms in numpy inside Spark tasks; nothing here needs ``pyspark.ml``, which workers would import.

Rows are binned once and held as blocks of one byte per value. A level of the trees is one pass: a task adds up
(count, sum, sum of squares) per node, feature and bin of one tree after the other, partial sums meet by tree and
range of nodes, and only the chosen splits reach the driver. A task walks its rows down the trees grown so
far instead of keeping their nodes, so no state is stored per row and tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 1 << 17
PART_ROWS = 1 << 22              # rows that a task holds at once, about 20 bytes each; every part sends sums of all nodes
ALONE_ROWS = 1 << 21             # rows whose boosted trees are grown inside one task
CHUNK_NODES = 64                 # nodes whose sums travel together
REBASE = 5                       # boosted trees that a task walks before predictions are stored anew
# copies of a row in a bootstrap sample by a random number of 16 bits: Poisson with mean 1
COPIES = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]) * 65536, np.arange(65536), "right").astype(np.uint8)


def at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at places known to exist; not checking them takes half the time."""
    return values.take(places, mode="clip")


def copies(n: int, *seed: int) -> np.ndarray:
    return COPIES[np.random.PCG64(seed).random_raw(-(-n // 4)).view(np.uint16)[:n]]


@dataclass
class Tree:
    """Nodes in the order they were made; a node without children sends every row to itself."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.intp))
    cut: np.ndarray = field(default_factory=lambda: np.full(1, 255, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.intp))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    stats: np.ndarray = field(default_factory=lambda: np.zeros((3, 1)))     # count, sum, sum of squares
    depth: int = 0

    def node_of(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Nodes of the rows whose codes begin at ``starts``."""
        node = np.zeros(len(starts), np.intp)
        for _ in range(self.depth):
            node = at(self.left, node) + (at(flat, starts + at(self.feature, node)) > at(self.cut, node))
        return node

    @property
    def mean(self) -> np.ndarray:
        return self.stats[1] / np.maximum(self.stats[0], 1)

    def split(self, nodes: np.ndarray, found: tuple, leaf: int) -> np.ndarray:
        """Split what gains by it; the children that may be split further."""
        gain, feature, cut, lefts, totals = found
        self.stats[:, nodes] = totals
        took = np.flatnonzero(gain > 1e-12 * totals[2])
        self.depth += 1
        parents, first = nodes[took], len(self.left)
        self.feature[parents], self.cut[parents], self.gain[parents] = feature[took], cut[took], gain[took]
        self.left[parents] = first + 2 * np.arange(len(took))
        made = np.arange(first, first + 2 * len(took))
        stats = np.stack([lefts[:, took], totals[:, took] - lefts[:, took]], 2).reshape(3, -1)
        # squares of larger children come with their own sums
        stats[2] = np.where(stats[0] == 1, stats[1] ** 2, stats[2])
        self.feature, self.cut = np.append(self.feature, np.zeros(len(made), np.intp)), np.append(self.cut, np.full(len(made), 255, np.uint8))
        self.left, self.gain = np.append(self.left, made), np.append(self.gain, np.zeros(len(made)))
        self.stats = np.concatenate([self.stats, stats], 1)
        return made[stats[0] >= 2 * leaf]


@dataclass
class Ask:
    """A tree whose open nodes are to be split; ``looked``: node x features tried there.

    Sums are (statistic and feature tried, node and bin): counts of all features, sums of all, squares of one. Children that
    are not asked again need the squares of ``all`` features.
    """

    number: int
    tree: Tree
    nodes: np.ndarray
    looked: np.ndarray
    all: bool

    def sums(self, bins: int) -> np.ndarray:
        k = self.looked.shape[1]
        return np.zeros((2 * k + (k if self.all else 1), len(self.nodes) * bins))

    def add(self, sums: np.ndarray, codes: np.ndarray, y: np.ndarray, weight: np.ndarray | None, bins: int) -> None:
        """Add the rows of a block (rows x features) to ``sums``; ``weight`` is the number of copies of a row."""
        flat, d = codes.reshape(-1), codes.shape[1]
        rows = np.arange(len(y)) if weight is None else np.flatnonzero(weight)
        starts = rows * d
        node = self.tree.node_of(flat, starts)
        if len(self.nodes) < len(self.tree.left):
            place = np.full(len(self.tree.left), -1)
            place[self.nodes] = np.arange(len(self.nodes))
            node = at(place, node)
            if len(node) and node.min() < 0:
                on = np.flatnonzero(node >= 0)
                node, rows, starts = at(node, on), at(rows, on), at(starts, on)
        y = at(y, rows)
        w = None if weight is None else at(weight, rows).astype(np.float64)
        wy = y if weight is None else w * y
        wyy = wy * y
        cells = node * bins
        k = self.looked.shape[1]
        for j in range(k):
            # of all features the columns stand in order
            feature = j if k == d else at(self.looked[:, j], node)
            cell = cells + at(flat, starts + feature)
            for out, values in zip(sums[j::k], (w, wy, wyy)):
                out += np.bincount(cell, values, len(out))

    def chunks(self, sums: np.ndarray, bins: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        parts = sums.reshape(len(sums), -1, bins)
        for i in range(0, len(self.nodes), CHUNK_NODES):
            yield (self.number, i), parts[:, i:i + CHUNK_NODES]


def best(sums: np.ndarray, looked: np.ndarray, leaf: int) -> tuple:
    """Per node the best split of sums (statistic and feature tried, node, bin): gain, feature, cut, left and total statistics."""
    nodes, k = looked.shape
    left = sums.cumsum(2)
    n, s, squares = left[:k], left[k:2 * k], left[2 * k:]
    total = np.stack([n[0, :, -1], s[0, :, -1], squares[0, :, -1]])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / n + (total[1, :, None] - s) ** 2 / (total[0, :, None] - n) - (total[1] ** 2 / total[0])[:, None]
    gain = np.where((n >= leaf) & (total[0, :, None] - n >= leaf), gain, -np.inf)
    bins = gain.shape[2]
    gain = gain.transpose(1, 0, 2).reshape(nodes, k * bins)
    at, row = gain.argmax(1), np.arange(nodes)
    j, cut = at // bins, at % bins
    lefts = np.stack([n[j, row, cut], s[j, row, cut], squares[j, row, cut] if len(squares) == k else np.full(nodes, np.nan)])
    return gain[row, at], looked[row, j], cut.astype(np.uint8), lefts, total


def joined(pieces: Sequence[tuple]) -> tuple:
    return tuple(np.concatenate(p, -1) for p in zip(*pieces))


def open_nodes(trees: Sequence[Tree], nodes: Sequence[np.ndarray], d: int, width: int, seed: int, squares: bool) -> list[Ask]:
    asked = []
    for t, (tree, some) in enumerate(zip(trees, nodes)):
        if len(some):
            rng = np.random.default_rng([seed, t, tree.depth])
            looked = np.sort(rng.random((len(some), d)).argsort(1)[:, :width], 1) if width < d else np.tile(np.arange(d), (len(some), 1))
            asked.append(Ask(t, tree, some, looked, squares))
    return asked


@dataclass
class Binned:
    """Training rows as blocks (codes, label less its mean) and what the codes stand for."""

    frame: DataFrame
    cuts: list[np.ndarray]
    rows: int
    centre: float

    @property
    def bins(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    def blocks(self, parts: int) -> RDD:
        cuts, centre = self.cuts, self.centre

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1).astype(np.uint8)
                y = batch.column(1).to_numpy() - centre
                yield pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["codes", "y"])

        def cut(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, n = [], 0
            for r in rows:
                held.append((np.frombuffer(r[0], np.uint8).reshape(-1, len(cuts)), np.frombuffer(r[1])))
                n += len(held[-1][1])
                if n >= BLOCK_ROWS:
                    yield tuple(np.concatenate(p) for p in zip(*held))
                    held, n = [], 0
            if held:
                yield tuple(np.concatenate(p) for p in zip(*held))

        rows = self.frame.mapInArrow(encode, "codes binary, y binary").rdd.map(tuple)
        return rows.repartition(parts).mapPartitions(cut, True) if rows.getNumPartitions() != parts else rows.mapPartitions(cut, True)


def binned(rows: DataFrame, bins: int) -> Binned:
    """Cuts between all values of a feature with few of them, else at its quantiles (actions).

    ``rows``: x (array of doubles), y (double). Values that are missing or not finite fail the run.
    """
    off = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    checked = rows.select(
        F.when(off, F.raise_error(F.lit("Vector values MUST NOT be NaN or Infinity"))).otherwise(F.col("x")).alias("x"),
        F.when(F.col("y").isNull() | F.isnan("y"), F.raise_error(F.lit("Labels MUST NOT be Null or NaN")))
        .when(F.abs("y") == float("inf"), F.raise_error(F.lit("Labels MUST NOT be Infinity"))).otherwise(F.col("y")).alias("y"))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, mean, d = None, 0, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            d = xs.shape[1]
            seen = seen or [np.zeros(0)] * d
            # one value more than there are bins tells that there are many
            seen = [s if len(s) > bins else np.union1d(s, xs[:, f])[:bins + 1] for f, s in enumerate(seen)]
            n += batch.num_rows
            mean += (batch.column(1).to_numpy() - mean).sum() / n
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean], pa.float64()), pa.array([[s.tolist() for s in seen]], pa.list_(pa.list_(pa.float64())))],
                                             names=["n", "mean", "seen"])

    found = checked.mapInArrow(values, "n long, mean double, seen array<array<double>>").collect()      # one row per partition
    n = sum(r["n"] for r in found)
    if not n:
        raise ValueError("DecisionTree requires size of input RDD > 0, but was given by empty one.")
    known = [sorted({v for r in found for v in r["seen"][f]}) for f in range(len(found[0]["seen"]))]
    cuts = [(np.array(k[:-1]) + np.array(k[1:])) / 2 for k in known]
    many = [f for f, k in enumerate(known) if len(k) > bins]
    if many:
        shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        got = checked.agg(*[F.percentile_approx(F.get("x", F.lit(f)), shares, 1_000).alias(f"f{f}") for f in many]).first()
        for f in many:
            cuts[f] = np.array(sorted(set(got[f"f{f}"])))
    return Binned(checked, cuts, n, math.fsum(r["mean"] * r["n"] for r in found) / n)


def grow_forest(data: Binned, n_trees: int, depth: int, width: int, leaf: int, bootstrap: bool, seed: int) -> list[Tree]:
    """All trees level by level (actions)."""
    spark = data.frame.sparkSession
    context, bins, d = spark.sparkContext, data.bins, len(data.cuts)
    parts = -(-data.rows // PART_ROWS)
    # few rows are few parts, whose trees are dealt over the cores instead
    groups = min(n_trees, -(-4 * context.defaultParallelism // parts))
    blocks = data.blocks(parts).persist(StorageLevel.MEMORY_AND_DISK)
    trees, nodes = [Tree() for _ in range(n_trees)], [np.zeros(1, np.intp) for _ in range(n_trees)]
    try:
        blocks.count()
        for level in range(depth):
            asked = open_nodes(trees, nodes, d, width, seed, leaf > 1 or level == depth - 1)
            if not asked:
                break
            sent = context.broadcast(asked)

            def summed(group: int, part: int, held: Iterator) -> Iterator:
                held = list(held)
                for ask in sent.value[group::groups]:
                    sums = ask.sums(bins)
                    for i, (codes, y) in enumerate(held):
                        ask.add(sums, codes, y, copies(len(y), seed, ask.number, part, i) if bootstrap else None, bins)
                    yield from ask.chunks(sums, bins)

            def chosen(chunks: Iterator) -> Iterator:
                met: dict[tuple, np.ndarray] = {}
                for key, chunk in chunks:
                    met[key] = met[key] + chunk if key in met else chunk
                looked = {a.number: a.looked for a in sent.value}
                for (t, i), chunk in met.items():
                    yield (t, i), best(chunk, looked[t][i:i + chunk.shape[1]], leaf)

            # sums of a single part are whole
            view = summed if parts > 1 else lambda group, part, held: chosen(summed(group, part, held))
            met = context.union([blocks.mapPartitionsWithIndex(partial(view, g)) for g in range(groups)])
            if parts > 1:
                met = met.partitionBy(max(4 * context.defaultParallelism, parts), lambda key: key[0] * 7919 + key[1] // CHUNK_NODES).mapPartitions(chosen)
            found = sorted(met.collect(), key=lambda f: f[0])
            nodes = [np.zeros(0, np.intp)] * n_trees
            for ask in asked:
                nodes[ask.number] = trees[ask.number].split(ask.nodes, joined([f for (t, _), f in found if t == ask.number]), leaf)
            sent.destroy()
    finally:
        blocks.unpersist()
    return trees


def boosted(steps: int, depth: int, d: int, bins: int, width: int, leaf: int, rate: float, seed: int,
            total: Callable[[Ask, bool], np.ndarray], settle: Callable[[Tree, float], None]) -> list[Tree]:
    """Trees fitted to what their predecessors leave; ``total`` adds up sums over all rows, ``settle`` takes a finished tree and its weight."""
    trees = []
    for step in range(steps):
        tree, nodes = Tree(), np.zeros(1, np.intp)
        for level in range(depth):
            if not len(nodes):
                break
            ask = open_nodes([tree], [nodes], d, width, seed + step, leaf > 1 or level == depth - 1)[0]
            sums = total(ask, step == 0)
            nodes = tree.split(nodes, best(sums.reshape(len(sums), -1, bins), ask.looked, leaf), leaf)
        settle(tree, 1.0 if step == 0 else rate)
        trees.append(tree)
    return trees


def predicted(codes: np.ndarray, before: np.ndarray, walked: Sequence[tuple[Tree, float]]) -> np.ndarray:
    flat, starts = codes.reshape(-1), np.arange(len(codes)) * codes.shape[1]
    for tree, weight in walked:
        before = before + at(weight * tree.mean, tree.node_of(flat, starts))
    return before


def grow_boosted(data: Binned, steps: int, depth: int, width: int, leaf: int, rate: float, seed: int) -> list[Tree]:
    """Each tree is fitted to what its predecessors leave, twice the residuals as the gradient has it (actions).

    Few rows are boosted inside one task; a pass over so few takes less time than starting it.
    """
    context, bins, d = data.frame.sparkSession.sparkContext, data.bins, len(data.cuts)
    cores, parts = context.defaultParallelism, -(-data.rows // PART_ROWS)
    options = (steps, depth, d, bins, width, leaf, rate, seed)

    def summed(blocks: Sequence[tuple], ask: Ask, first: bool, walked: Sequence[tuple[Tree, float]] = ()) -> np.ndarray:
        sums = ask.sums(bins)
        for codes, y, before in blocks:
            ask.add(sums, codes, y if first else 2 * (y - predicted(codes, before, walked)), None, bins)
        return sums

    def alone(held: Iterator) -> Iterator[list[Tree]]:
        blocks = [(codes, y, np.zeros(len(y))) for codes, y in held]

        def settle(tree: Tree, weight: float) -> None:
            blocks[:] = [(codes, y, predicted(codes, before, [(tree, weight)])) for codes, y, before in blocks]

        yield boosted(*options, lambda ask, first: summed(blocks, ask, first), settle)

    if data.rows <= ALONE_ROWS:
        return data.blocks(1).mapPartitions(alone).collect()[0]
    # as many parts for every core
    first_state = data.blocks(cores * -(-parts // cores)).map(lambda b: (*b, np.zeros(len(b[1])))).persist(StorageLevel.MEMORY_AND_DISK)
    states, recent = [first_state], []

    def total(ask: Ask, first: bool) -> np.ndarray:
        walked = list(recent)
        # a handful of nodes: the sums of a part are small enough for the driver
        got = states[-1].mapPartitions(lambda held: [summed(held, ask, first, walked)]).collect()
        while len(states) > 1:
            states.pop(0).unpersist()
        return sum(got)

    def settle(tree: Tree, weight: float) -> None:
        recent.append((tree, weight))
        if len(recent) == REBASE:
            walked = list(recent)
            recent.clear()
            states.append(states[-1].map(lambda b: (b[0], b[1], predicted(b[0], b[2], walked))).persist(StorageLevel.MEMORY_AND_DISK))

    try:
        return boosted(*options, total, settle)
    finally:
        for state in states:
            state.unpersist()
