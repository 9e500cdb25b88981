"""Whitening of embeddings with Spark MLlib's distributed block matrices.

Rows get contiguous numbers, centred rows become an IndexedRowMatrix and then a BlockMatrix; the transposed
matrix times itself is the scatter, its small local eigendecomposition gives the whitening matrix, and the
BlockMatrix times that matrix projects the rows. Everything with one entry per row stays in the JVM.

The product for the scatter has a single result block, so its middle dimension is split: every task adds up
the products of a bounded number of blocks. Rows are worked off in slices, so that the block numbers that
MLlib plans with on the driver, and row numbers inside a matrix, stay bounded whatever the table's size.

Defined results: rows with a null vector or a null or non-finite entry are left out, and so are empty vectors
and vectors of another length than most have (ties: the longer). A null id is kept, repeated rows count each
time. Components without variance (one row, equal rows, dependent dimensions) have whitened 0.0 and take no
part in identity_error; a deviation beyond the range of long is null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from aeroframe.llm import common

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 53              # scaled entries beyond it count as it
BLOCK_VALUES = 1 << 18           # entries of a block: 2 MB
BLOCKS_PER_TASK = 32             # whose products one task adds up
SLICE_ROWS = 1 << 28             # rows of one matrix
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vector: Column | str) -> Column:
    """floor(1024 * c) + 100000 of every entry; null for a vector with a null or non-finite entry."""
    vector = F.col(vector) if isinstance(vector, str) else vector

    def sound(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), SCALE * c.cast("double")))) + SHIFT

    x = F.transform(vector, whole)
    return F.when(F.forall(vector, sound), x)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once, with contiguous numbers ``row`` from 0 (an action)."""
    place = F.monotonically_increasing_id()
    pinned = common.materialise(df.withColumn("_m", place), label)
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per task that wrote
    sizes = sorted((r["p"], r["k"]) for r in pinned.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect())
    starts = np.concatenate(([0], np.cumsum([k for _, k in sizes])))
    firsts = df.sparkSession.createDataFrame([(p, int(a)) for (p, _), a in zip(sizes, starts)], "p long, first long")
    return pinned.join(F.broadcast(firsts), part == F.col("p")).withColumn("row", inside + F.col("first")).drop("_m", "p", "first")


def _blocks(centred: DataFrame, n: int, d: int) -> BlockMatrix:
    """BlockMatrix of (row, v array<double>)."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select("row", array_to_vector("v").alias("v")), "v")
    indexed = callMLlibFunc("createIndexedRowMatrix", rows, n, d)
    height = max(1, BLOCK_VALUES // d)
    return BlockMatrix(indexed.toBlockMatrix(height, d), height, d)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product with the middle dimension cut in ``splits``, a parameter only the JVM method has."""
    made = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """Sum over rows of the outer product of the row with itself."""
    splits = -(-blocks.numRowBlocks // BLOCKS_PER_TASK)
    return _times(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns), the largest entry of each vector positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    leading = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
    return values, vectors * np.where(leading < 0, -1, 1)


def _projected(blocks: BlockMatrix, whitening: np.ndarray, spark) -> DataFrame:
    """(row, w array<double>): the rows of ``blocks`` times the whitening matrix."""
    d, k = whitening.shape
    local = DenseMatrix(d, k, whitening.ravel("F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), d, k, d, k)
    found = callMLlibFunc("getIndexedRows", blocks.multiply(right)._java_matrix_wrapper.call("toIndexedRowMatrix"))
    return found.select(F.col("index").alias("row"), vector_to_array("vector").alias("w"))


def identity_error(rows: DataFrame, kept: int) -> float:
    """Largest absolute entry of (covariance of the first ``kept`` entries of ``w``) minus the identity."""
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    if not pairs:
        return 0.0
    found = rows.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of (vec_id, embedding) and component."""
    spark = vectors.sparkSession
    sound = vectors.select("vec_id", whole_numbers("embedding").alias("x")).where("size(x) > 0")
    common_size = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common_size is None:
        return spark.createDataFrame([], RESULT)
    n, d = common_size["count"], common_size["d"]
    rows = numbered(sound.where(F.size("x") == d), "whitening-rows")
    halves = F.sum(F.shiftright("col", 20)).alias("high"), F.sum(F.col("col").bitwiseAND(F.lit((1 << 20) - 1))).alias("low")
    found = rows.select(F.posexplode("x")).groupBy("pos").agg(*halves).collect()            # one row per dimension
    sums = [(r["high"] << 20) + r["low"] for r in sorted(found)]
    total = F.array(*[F.lit(s if abs(s) < 1 << 63 else None).cast("long") for s in sums])
    means = F.array(*[F.lit(s / n) for s in sums])
    apart = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    square = F.aggregate(apart, F.lit(0).cast("long"), lambda a, c: F.try_add(a, F.try_multiply(c, c)))
    centred = F.transform(F.arrays_zip(apart.alias("a"), F.col("x"), means.alias("m")), lambda r: F.coalesce(r["a"] / F.lit(float(n)), r["x"] - r["m"]))
    exact = common.materialise(rows.select("row", "vec_id", square.alias("deviation"), centred.alias("v")), "whitening-centred")

    slices = []
    for first in range(0, n, SLICE_ROWS):
        size = min(SLICE_ROWS, n - first)
        part = exact.where((F.col("row") >= first) & (F.col("row") < first + size)).select((F.col("row") - first).alias("row"), "v")
        slices.append((first, _blocks(part, size, d)))
    values, axes = principal(sum(_scatter(blocks) for _, blocks in slices) / n)
    k = min(components, d)
    varied = values[:k] > d * np.finfo(float).eps * values[0]
    scale = np.where(varied, 1 / np.sqrt(np.where(varied, values[:k], 1)), 0)
    parts = [_projected(blocks, axes[:, :k] * scale, spark).withColumn("row", F.col("row") + F.lit(first)) for first, blocks in slices]
    projected = parts[0]
    for more in parts[1:]:
        projected = projected.unionAll(more)
    projected = common.materialise(projected, "whitening-projected")
    error = identity_error(projected, int(varied.sum()))
    share = values[:k] / values.sum() if values.sum() else np.zeros(k)

    joined = exact.select("row", "vec_id", "deviation").join(projected, "row").select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return joined.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(float(s)) for s in share]), F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
