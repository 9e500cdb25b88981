"""A training-corpus pipeline: reject bad documents, keep one of each near-duplicate group, mix, pack.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``, whatever they
are called; a null or empty text, a null id or source, repeated rows and an empty table have the results
that the operators define. Labels are learned from the tables in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroframe.llm import common, decision_list, ga2m, minhash, mixing, packing, queries


def _unused(docs: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    known = common.table(spark, sf_dir, "documents", "doc_id", "text")
    rules = decision_list.fit(known, common.table(spark, sf_dir, "labels", "doc_id", "quality"))
    verdict = _unused(docs, "_verdict")
    return decision_list.apply(docs, rules, verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    known = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = ga2m.fit(known, common.table(spark, sf_dir, "labels", "doc_id", "quality"))
    score = _unused(docs, "_score")
    return docs.withColumn(score, ga2m.scored(model, "text")).where(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five words, 0.8): the one with the group's smallest id.

    Repeated rows count once. Texts without words and documents that share only their id are in no common group
    and all stay; rows without an id are in no group either. Whole texts are compared, whatever their length.
    """
    tag = _unused(docs, "_tag")
    marked = docs.withColumn(tag, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = minhash.near_duplicates(marked.select("doc_id", "text", F.col(tag).alias("tag")), size=5)
    # of several texts with the group's smallest id the least one; a text without words has no group but itself
    group = F.coalesce("component", "tag")
    stay = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy(group.alias("g"), "doc_id").agg(F.min("tag").alias(tag)).select("doc_id", tag)
    one_each = marked.join(stay, ["doc_id", tag], "left_semi").dropDuplicates(["doc_id", tag])
    return one_each.unionByName(marked.where(F.col("doc_id").isNull())).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of whole documents as the mix draws them, shuffled inside their shard.

    The last copy drawn of a source stays if at least half of it is wanted.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), whole.alias("_doc"))
    drawn = mixing.mix(rows).where(F.col("copy").isNotNull() & (2 * F.col("words") >= F.col("size")))
    shards = drawn.repartition("shard").sortWithinPartitions("shard", "place")
    return shards.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, queries.public_ranks())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# learned rules and scores have no SQL counterpart; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
