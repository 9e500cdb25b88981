"""Exact top-k inner products with a vector-approximation file.

Vectors are kept in blocks of bounded size, each with an approximation: every component is replaced by
one of 64 cells. A query block meets a vector block in one task. The cells give an upper and a lower
bound of every score; vectors whose upper bound is below the k-th lower bound are never read, the rest
are read exactly in order of their upper bounds until the k-th exact score beats the next bound. The
best k of every block are merged per query.

Defined results: vectors that are null, empty of an id, or hold null or non-finite components take no
part; repeated rows (same id and vector) count once; rows that share the query's id are its own and are
no candidates; vectors of another length than the query's are not comparable with it; scores beyond the
range of long are held at its ends; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 4096
CELLS = 64
_EXACT = 2 ** 52


def scaled(embedding: Column | str, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if any component is unusable."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(usable, F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Approximation:
    """Cells of a block of vectors; bounds are twice the score so that they stay whole numbers."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        low, high = vectors.min(0), vectors.max(0)
        width = np.maximum(-(-(high - low + 1) // CELLS), 1)
        self.codes = ((vectors - low) // width).astype(np.uint8)
        first = low + self.codes.astype(np.int64) * width
        last = np.minimum(first + width - 1, high)
        self._sum, self._spread = (first + last).astype(float), (last - first).astype(float)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Doubled (lower, upper) bounds, one row per query."""
        middle, reach = queries @ self._sum.T, np.abs(queries) @ self._spread.T
        return middle - reach, middle + reach

    def best(self, query: np.ndarray, own: np.ndarray, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray,
             k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, vectors read) of the k best, ties to smaller ids; ``own`` marks rows to leave out."""
        lower, upper = np.where(own, -np.inf, lower), np.where(own, -np.inf, upper)
        least = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
        open_ = np.flatnonzero((upper >= least) & ~own)
        open_ = open_[np.argsort(-upper[open_], kind="stable")]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while at < len(open_):
            if len(found) >= k and 2 * scores[k - 1] > upper[open_[at]]:
                break
            part = open_[at:at + 4 * k]
            found = np.concatenate((found, ids[part]))
            scores = np.concatenate((scores, self.vectors[part] @ query))
            order = np.lexsort((found, -scores))[:k]
            found, scores = found[order], scores[order]
            at += len(part)
        return found, scores, at


def _plain_best(query: list[int], vectors: list[list[int]], ids: list[int], k: int) -> list[tuple[int, int]]:
    """The same for numbers too large for exact doubles."""
    clamp = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    scores = sorted((-clamp(sum(a * b for a, b in zip(query, v))), i) for v, i in zip(vectors, ids))
    return [(i, -s) for s, i in scores[:k]]


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of distinct rows by vector length."""
    lists = table.column("v").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    ids = table.column("vec_id").to_numpy()
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        rows = flat[starts[at][:, None] + np.arange(d)].astype(np.int64)
        keyed = np.unique(np.column_stack((ids[at], rows)), axis=0)
        out[int(d)] = (keyed[:, 0], keyed[:, 1:])
    return out


def search_block(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """Best k of one block of vectors for every query of one block."""
    found: list[tuple[int, int, int, int]] = []
    known = _matrices(vectors)
    for d, (query_ids, q) in _matrices(queries).items():
        if d not in known:
            continue
        ids, v = known[d]
        big = max(1, d) * 4.0 * max(1.0, float(np.abs(q.astype(float)).max(initial=0))) * max(1.0, float(np.abs(v.astype(float)).max(initial=0)))
        if big >= _EXACT:
            for i, (query_id, row) in enumerate(zip(query_ids.tolist(), q.tolist())):
                other = ids != query_id
                found += [(query_id, i, a, s) for a, s in _plain_best(row, v[other].tolist(), ids[other].tolist(), k)]
            continue
        near = Approximation(v) if d else None
        for begin in range(0, len(q), 256):
            part = q[begin:begin + 256]
            lower, upper = near.bounds(part.astype(float)) if near else (np.zeros((len(part), len(ids))),) * 2
            for j, query_id in enumerate(query_ids[begin:begin + 256].tolist()):
                own = ids == query_id
                if near:
                    got, scores, _ = near.best(part[j], own, lower[j], upper[j], ids, k)
                else:                                   # vectors without components: all scores are 0
                    got = ids[~own][:k]
                    scores = np.zeros(len(got), np.int64)
                found += [(query_id, begin + j, a, s) for a, s in zip(got.tolist(), scores.tolist())]
    columns = list(zip(*found)) or [()] * 4
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("query_id", "variant", "vec_id", "score"), columns)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, v) where ``is_query`` holds; v from ``scaled``.

    Counts both sides once to size the blocks. A vector is sent to every query block and a query to
    every vector block; no task holds more than about one block of each.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    queries = usable.where(is_query)
    sizes = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    vector_blocks, query_blocks = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // block))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.select(
            "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    left = dealt(queries, "qb", query_blocks, "vb", vector_blocks).groupBy("qb", "vb")
    right = dealt(usable, "vb", vector_blocks, "qb", query_blocks).select("vec_id", "v", "qb", "vb").groupBy("qb", "vb")
    best = left.cogroup(right).applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, variant long, vec_id long, score long")
    order = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
