"""Quality rules: an ordered list of threshold conjunctions learned by sequential covering.

Rules for the minority verdict (reject) are grown one condition at a time by information gain on two
thirds of the labelled rows, pruned on the other third, and added while they stay precise. The list is
emitted as one Spark conditional expression. Defined results: null, empty and blank texts have all
statistics zero and fail the base rule; repeated documents get the same verdict; without usable labels
the list is empty and only the base rule decides; other columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from aeroframe.llm import common, textstats

MAX_TRAINING_ROWS = 20_000
LEAST_SUPPORT = 3                # rejected rows that a rule must find among those it was not grown on


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, textstats.FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, of: Column) -> Column:
        v = of[self.feature]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _best_condition(x: np.ndarray, y: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    """The condition with the largest gain: covered rejects times the rise of log precision."""
    p, n = int(y.sum()), int((~y).sum())
    base = np.log2(p / (p + n))
    best, found = 1e-9, None
    for j, name in enumerate(textstats.FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, pos = x[order, j], np.cumsum(y[order])
        ends = np.flatnonzero(v[1:] > v[:-1])         # last row of each distinct value but the largest
        if not len(ends):
            continue
        if len(ends) > cuts:                          # even steps through the covered rejects and the rows
            target = np.linspace(0, p, cuts // 2)
            ends = ends[np.unique(np.concatenate((
                np.minimum(np.searchsorted(pos[ends], target), len(ends) - 1),
                np.linspace(0, len(ends) - 1, cuts // 2).astype(int))))]
        below_p, below = pos[ends], ends + 1
        for above, tp, all_ in ((False, below_p, below), (True, p - below_p, p + n - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(tp > 0, tp * (np.log2(tp / all_) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best = float(gain[k])
                found = Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return best, found


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = _covers(rule, x)
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, reject: np.ndarray, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.9,
          cuts: int = 200) -> list[Rule]:
    """Ordered rules for ``reject``; each must keep the given precision on rows it was not grown on.

    The rows of a rule that misses it are set aside while further rules grow; they still count against those.
    """
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    open_, aside = np.ones(len(x), bool), np.zeros(len(x), bool)
    for _ in range(4 * max_rules):
        grow = open_ & ~prune & ~aside
        if len(rules) == max_rules or not reject[grow].any() or not reject[open_ & prune].any():
            break
        gx, gy, rule = x[grow], reject[grow], ()
        while len(rule) < max_conditions and gy.any() and not gy.all():
            _, c = _best_condition(gx, gy, cuts)
            if c is None:
                break
            rule = (*rule, c)
            hit = c.holds(gx)
            gx, gy = gx[hit], gy[hit]
        px, py = x[open_ & prune], reject[open_ & prune]
        worth = [_worth(rule[:k], px, py) for k in range(1, len(rule) + 1)]
        if not worth:
            break
        rule = rule[:int(np.argmax(worth)) + 1]
        covered = _covers(rule, x)
        if (max(worth) + 1) / 2 < precision or (covered & reject & open_ & prune).sum() < LEAST_SUPPORT:
            aside |= covered
            continue
        rules.append(rule)
        open_ &= ~covered
    return rules


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> list[Rule]:
    """Learn from at most ``max_rows`` labelled documents, those that the base rule does not reject anyway.

    Only their statistics reach the driver.
    """
    rows = common.labelled(documents, labels, label, max_rows)
    measured = rows.select("doc_id", "label", textstats.statistics("text").alias("s"))
    got = measured.where(~base_failed(F.col("s"))).select("doc_id", "label", *[F.col("s")[f].alias(f) for f in textstats.FEATURES]).toPandas()
    got = got.sort_values(["doc_id", *textstats.FEATURES], kind="stable")
    x = got[list(textstats.FEATURES)].to_numpy(float).reshape(-1, len(textstats.FEATURES))
    return learn(x, got["label"].to_numpy() == 0)


def expression(rules: list[Rule], of: Column) -> Column:
    """Number of the first rule that fires on the statistics ``of``, from 1; 0 if none does."""
    fired = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(of)
        for c in rule[1:]:
            test = test & c.column(of)
        fired = F.when(test, F.lit(k)) if fired is None else fired.when(test, F.lit(k))
    return F.lit(0) if fired is None else fired.otherwise(F.lit(0))


def base_failed(of: Column) -> Column:
    return (of["n_words"] < 20) | (100 * of["n_repeat_words"] > 30 * of["n_words"])


def apply(documents: DataFrame, rules: list[Rule], into: str) -> DataFrame:
    """Add a struct column ``into``: statistics s, base_failed, rule, kept. Other columns stay."""
    measured = documents.withColumn(into, textstats.statistics("text"))
    s = F.col(into)
    failed, rule = base_failed(s), expression(rules, s)
    return measured.withColumn(into, F.struct(
        s.alias("s"), failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept")))
