"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams (one to three letters, words
padded with a blank). A document is ranked the same way and compared to each profile by the out-of-place
distance: the sum over its n-grams of how far their ranks lie apart, the profile length for an n-gram
the profile lacks. The nearest profile wins.

Defined results: texts that are null or without a letter are ``und`` with score 0, as is every text when
there is nothing to learn from; of equally near languages the first by code point wins; n-grams of equal
count rank by code point; repeated documents count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PROFILE = 400
_FLUSH = 1_000_000
_SHIFT = 21                     # bits of one code point


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Keys of all n-grams of a text: up to three code points in 21 bits each, 0 for the blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.concatenate(([0], np.where(_letters()[c], c, 0), [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << _SHIFT) | c[1:]
    three = (two[:-1] << _SHIFT) | c[2:]
    return np.concatenate((c[c != 0], two + (1 << 62), three[c[1:-1] != 0] | np.int64(-1 << 63)))


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, best first."""
    keys, n = np.unique(grams(text), return_counts=True)
    if len(keys) > size:            # drop what is surely behind the last place before sorting
        least = np.partition(n, len(n) - size)[len(n) - size]
        at = n >= least
        keys, n = keys[at], n[at]
    return keys[np.argsort(-n, kind="stable")][:size]


def count_grams(documents: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``documents`` (text, lang); every task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            fresh: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fresh.setdefault(lang, []).append(text)
            for lang, texts in fresh.items():
                size, part = 0, []
                for i, text in enumerate(texts):
                    part.append(grams(text))
                    size += len(part[-1])
                    if size > 4_000_000 or i == len(texts) - 1:
                        _add(held, lang, *np.unique(np.concatenate(part), return_counts=True))
                        size, part = 0, []
            if sum(len(k) for k, _ in held.values()) > _FLUSH:
                yield from flush()
        yield from flush()

    counted = documents.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _add(held: dict, lang: str, keys: np.ndarray, n: np.ndarray) -> None:
    if lang in held:
        keys, at = np.unique(np.concatenate((held[lang][0], keys)), return_inverse=True)
        n = np.bincount(at, np.concatenate((held[lang][1], n))).astype(np.int64)
    held[lang] = [keys, n]


def learn(documents: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of every language in ``documents`` (text, lang): ``size`` n-grams each reach the driver."""
    rows = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = count_grams(rows).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    got = top.select("lang", "gram", "rank").toPandas().sort_values(["lang", "rank"])
    return {lang: g["gram"].to_numpy(np.int64) for lang, g in got.groupby("lang")}


class Profiles:
    """Rank of every known n-gram in every language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much nearer than the farthest possible the winner is, 0 to 1."""
        best = ranked(text, self.size) if text else ()
        if not len(best) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, best), len(self.keys) - 1)
        at[self.keys[at] != best] = len(self.keys)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(best))[:, None])).sum(0)
        j = int(np.argmin(away))
        return self.langs[j], 1.0 - float(away[j]) / (self.size * len(best))


def predicted(profiles: Profiles, text: Column | str) -> Column:
    """Struct (lang, score) for a text column."""

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        got = [profiles.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                          names=["lang", "score"])

    return predict.asNondeterministic()(text)
