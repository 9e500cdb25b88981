"""Reading, folds, bounded label samples and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeroframe.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one table, so that extra columns cannot clash with what is added later."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def remainder(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % k


def in_fold(doc_id: Column | str, k: int, r: int) -> Column:
    """Whether the remainder is r; a null id is in no fold."""
    return F.coalesce(remainder(doc_id, k) == r, F.lit(False))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the folder all executors share and read it back (an action).

    Cuts the lineage at a copy that outlives executors; the file system drops it when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def sampled_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``max_rows`` labelled ids, those with the smallest hashes.

    Repeated rows of one id count once (the largest label); rows without id or label are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    once = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, label) of the sampled ids; the sample is at most ``max_rows`` ids, so it is broadcast."""
    chosen = F.broadcast(sampled_labels(labels, label, max_rows))
    return documents.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "label")
