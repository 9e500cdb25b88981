"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are laid end to end in a hashed order; the line, repeated up to the cap, is cut
at the source's target and divided into blocks of equal length. A tree over the output shards splits
the block quotas of all sources exactly: a node draws its left half's quotas from a multivariate
hypergeometric distribution seeded by the node, so every shard finds its own blocks by walking one path.
Documents follow the block they start in and are shuffled by hash inside their shard.

Defined results: a null source is a source of its own, ranked last; null and empty texts have size 0
and are never drawn; rows that agree in id, source and size are interchangeable but all kept; an empty
table gives an empty mix. The last document drawn of a source may be taken in part, so each source is
met to the word. Per source one row (size, target, quota) reaches the driver, nothing per document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BLANK = r"[\x20\x09-\x0D]"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
_BUCKET_DIGITS = 4


def word_count(text: Column | str) -> Column:
    """Number of words; the words are replaced by one letter each instead of being listed."""
    trimmed = F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), BLANK + r"+\z", "")
    return F.length(F.regexp_replace(trimmed, BLANK + r"*[^\x20\x09-\x0D]+", "x")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With sources ordered by the level at which their cap binds, the level of the first one that stays
    below its cap is the common level of all that do. One row per source, so one task is enough.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                   (F.col("_rank") % len(weights) + 1).cast("int")))
    limit = (F.col("source_size") * cap).cast("double")
    by_level = everything.orderBy(limit / F.col("_w"), "_rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.withColumns({
        "_place": F.row_number().over(by_level),
        "_level": (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))})
    below = limit >= F.col("_w") * F.col("_level")
    level = F.min_by("_level", F.when(below, F.col("_place"))).over(everything)
    return levels.withColumn("_l", level).select(
        "source", "source_size", F.least(limit, F.col("_w") * F.coalesce(F.col("_l"), F.lit(0.0))).alias("target"))


def lay_out(rows: DataFrame, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add source_size, target, _limit (whole words to take) and _start (place on the source's line).

    ``rows`` needs doc_id, source and size; it is read three times, so write it first if it is dear.
    """
    keyed = rows.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, _BUCKET_DIGITS))
    buckets = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    sources = buckets.groupBy("source").agg(F.sum("_words").alias("source_size"))
    # at most 16 ** 4 buckets of a source, whatever its size
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (buckets.withColumn("_offset", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
               .join(source_targets(sources, weights, cap).withColumnRenamed("source", "_of"),
                     F.col("source").eqNullSafe(F.col("_of"))).drop("_of", "_words")
               .withColumnsRenamed({"source": "_s", "_bucket": "_b"}))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
    placed = keyed.withColumns({
        "_nth": F.row_number().over(inside),
        "_here": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")})
    return (placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("_start", F.col("_here") + F.col("_offset"))
            .withColumn("_limit", F.round("target").cast("long"))
            .drop("_s", "_b", "_here", "_offset"))


def copies(laid: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per drawn copy: copy (from 0), words (taken of it) and _at (place on the repeated line).

    Rows of which nothing is drawn stay, once, with a null copy and 0 words.
    """
    def drawn(k: Column) -> Column:
        at = k * F.col("source_size") + F.col("_start")
        return F.struct(k.cast("int").alias("copy"), at.alias("at"),
                        (F.least(F.col("_limit"), at + F.col("size")) - at).alias("words"))

    some = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(cap - 1).cast("long")), drawn), lambda c: c["words"] > 0)
    return (laid.withColumn("_c", F.explode_outer(some))
            .withColumns({"copy": F.col("_c.copy"), "words": F.coalesce("_c.words", F.lit(0).cast("long")), "_at": F.col("_c.at")})
            .drop("_c"))


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of every source for one shard, by walking its path of the tree."""
    lo, hi, left, first = 0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    total = int(left.sum())
    bound = lambda j: j * total // shards  # noqa: E731  blocks of all shards before j
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        drawn = rng.multivariate_hypergeometric(left, bound(mid) - bound(lo), method="marginals")
        if shard < mid:
            hi, left = mid, drawn
        else:
            lo, first, left = mid, first + drawn, left - drawn
    return first, left


def shard_of_blocks(laid: DataFrame, block_words: int, shard_words: int, seed: int) -> tuple[DataFrame, int]:
    """((_s, _block, shard) for every drawn block, block length); an action over one row per source."""
    spark = laid.sparkSession
    per_source = laid.groupBy("source").agg(F.max("_limit").alias("limit")).toPandas()
    names = per_source["source"].tolist()
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    names = [names[i] for i in order]
    limits = per_source["limit"].to_numpy(np.int64)[order]
    total = int(limits.sum())
    while total // block_words >= 5 * 10 ** 8:      # the generator draws from fewer than 10 ** 9 blocks
        block_words *= 2
    quotas = -(-limits // block_words)
    shards = max(1, math.ceil(total / shard_words))

    def ranges(batches):
        for batch in batches:
            for shard in batch["id"]:
                first, n = shard_quotas(quotas, shards, int(shard), seed)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"_s": pd.Series([names[i] for i in at], dtype=object), "_first": first[at],
                                    "_last": first[at] + n[at] - 1, "shard": np.full(len(at), shard, np.int64)})

    found = spark.range(shards).mapInPandas(ranges, "_s string, _first long, _last long, shard long")
    return found.select("_s", F.explode(F.sequence("_first", "_last")).alias("_block"), "shard"), block_words


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """The mix of ``rows`` (doc_id, source, size and any other columns).

    Adds source_size, target, copy, words, shard and place (order inside the shard); rows of which
    nothing is taken stay once with null copy, shard and place.
    """
    laid = lay_out(rows, cap, weights)
    blocks, length = shard_of_blocks(laid, block_words, shard_words, seed)
    drawn = copies(laid, cap).withColumn("_block", F.floor(F.col("_at") / length).cast("long"))
    placed = drawn.join(blocks.withColumnRenamed("_block", "_of"),
                        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_of")), "left")
    place = F.xxhash64(F.lit(seed), "shard", "_key", "copy", "_nth")
    return (placed.withColumn("place", F.when(F.col("copy").isNotNull(), place))
            .withColumn("_row", F.struct("source", "_bucket", "_nth"))
            .drop("_s", "_of", "_block", "_at", "_key", "_bucket", "_nth", "_start", "_limit"))


def taken_words(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS,
                shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: its words inside the blocks that the shards draw.

    A copy's stretch of its source's line may lie in several blocks; it counts as far as some shard draws them.
    """
    laid = lay_out(rows, cap, weights)
    blocks, length = shard_of_blocks(laid, block_words, shard_words, seed)
    last = F.col("_at") + F.col("words") - 1
    crossed = F.sequence(F.floor(F.col("_at") / length).cast("long"), F.floor(last / length).cast("long"))
    pieces = copies(laid, cap).withColumn("_block", F.explode_outer(F.when(F.col("copy").isNotNull(), crossed)))
    met = pieces.join(blocks.withColumnRenamed("_block", "_of"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_of")), "left")
    begin, end = F.col("_of") * length, (F.col("_of") + 1) * length
    inside = F.when(F.col("_of").isNotNull(), F.least(last + 1, end) - F.greatest("_at", begin)).otherwise(0)
    one = ["source", "_bucket", "_nth", "doc_id", "size", "source_size", "target"]
    return met.groupBy(*one).agg(F.sum(inside).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, blanks between words as they are."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
