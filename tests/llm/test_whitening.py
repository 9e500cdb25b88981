"""Whitening against numpy."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest

from aeroframe.llm import common, queries, whitening


def brute(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in kept)
    d = max(sizes, key=lambda s: (sizes[s], s))
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in kept if len(v) == d]
    x = np.array([v for _, v in kept], dtype=object)
    n, s = len(x), x.sum(0)
    apart = n * x - s
    centred = (apart / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in kept], (apart * apart).sum(1), centred, values, vectors


@pytest.mark.parametrize("rows_of_a_block", [None, 16])
def test_query(spark, tmp_path, monkeypatch, rows_of_a_block):
    if rows_of_a_block:
        monkeypatch.setattr(whitening, "BLOCK_VALUES", 8 * rows_of_a_block)
        monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
        monkeypatch.setattr(whitening, "SLICE_ROWS", 70)
    corpus.write(str(tmp_path))
    got = queries.QUERIES["op13_block_matrix_whitening"](spark, str(tmp_path)).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    ids, deviations, centred, values, vectors = brute(rows)
    k = min(8, centred.shape[1])
    assert Counter(r["vec_id"] for r in got) == Counter({i: c * k for i, c in Counter(ids).items()})
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter({x: c * k for x, c in Counter(zip(ids, deviations)).items()})
    assert {r["n"] for r in got} == {len(ids)} and all(r["identity_error"] < 1e-9 for r in got)
    by = defaultdict(list)
    for i, line in zip(ids, centred @ vectors[:, :k] / np.sqrt(np.where(values[:k] > 1e-9, values[:k], np.inf))):
        by[i].append(line)
    once = {i for i, lines in by.items() if len(lines) == 1}
    for c in range(k):
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1 and r["vec_id"] in once}
        pairs = [(r["whitened"], by[i][0][c]) for i, r in mine.items()]
        sign = np.sign(sum(a * b for a, b in pairs)) or 1
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-8
        assert all(r["explained"] == pytest.approx(max(values[c], 0) / values.sum(), rel=1e-9, abs=1e-12) for r in mine.values())


@pytest.mark.parametrize("vectors, kept", [([[1.0, 2.0]], 1), ([[1.0, 2.0]] * 3, 3), ([[1.0, 1.0], [2.0, 2.0], [4.0, 4.0]], 3), ([None, []], 0), ([[3e38, 1.0], [1.0, 1.0]], 2)])
def test_little_or_no_variance(spark, vectors, kept):
    rows = [(i, v) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 2 * kept
    if vectors[0] == [1.0, 2.0]:
        assert all(r["whitened"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in got)
    if vectors[0] == [1.0, 1.0]:
        assert {round(r["explained"], 6) for r in got} == {0.0, 1.0} and max(r["identity_error"] for r in got) < 1e-9


def test_rows_get_contiguous_numbers(spark):
    frame = spark.range(0, 1000, 1, 7)
    assert sorted(r["row"] for r in whitening.numbered(frame, "t").collect()) == list(range(1000))
    assert whitening.numbered(frame.limit(0), "t").count() == 0
    assert common.WORD
