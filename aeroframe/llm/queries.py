"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroframe.llm import (
    common, decision_list, ga2m, grulm, langid, licences, mincut, minhash, mixing, packing, toxicity, vafile, variants, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op1_rank_profiles")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by out-of-place distance."""
    documents = common.table(spark, folder, "documents", "doc_id", "text", "lang")
    profiles = langid.Profiles(langid.learn(documents.where(common.remainder("doc_id", 4) != 2)))
    found = documents.select("doc_id", common.in_fold("doc_id", 4, 2).alias("held_out"), langid.predicted(profiles, "text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op2_decision_list")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics of every document and the verdict of the learned decision list."""
    documents = common.table(spark, folder, "documents", "doc_id", "text")
    rules = decision_list.fit(documents, common.table(spark, folder, "labels", "doc_id", "quality"))
    done = decision_list.apply(documents, rules, "r")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return done.select("doc_id", *[F.col("r.s")[c].alias(c) for c in base], "r.base_failed", "r.kept", "r.rule")


@query("op3_deobfuscated_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, scored on restored text."""
    documents = common.table(spark, folder, "documents", "doc_id", "text")
    scorer = toxicity.fit(documents.where(common.remainder("doc_id", 5) != 0), common.table(spark, folder, "labels", "doc_id", "toxic"))
    found = documents.select("doc_id", common.in_fold("doc_id", 5, 0).alias("held_out"), toxicity.scored(scorer, "text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op4_pairwise_additive")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by the additive model with pairwise interactions."""
    documents = common.table(spark, folder, "documents", "doc_id", "text")
    labels = common.table(spark, folder, "labels", "doc_id", "quality").where(common.remainder("doc_id", 3) != 1)
    model = ga2m.fit(documents, labels)
    found = documents.select("doc_id", common.in_fold("doc_id", 3, 1).alias("held_out"), ga2m.scored(model, "text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op5_gated_recurrent")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Log-likelihood of every document under the recurrent model and under the unigram base."""
    documents = common.table(spark, folder, "documents", "doc_id", "text")
    in_training = common.remainder("doc_id", 7) != 2
    counted = common.materialise(grulm.count_words(documents.where(in_training)), "word-counts")
    vocabulary = grulm.vocabulary(counted)
    coded = grulm.encode(documents, vocabulary)
    return grulm.score(coded, counted, grulm.fit(grulm.texts_of(coded).where(in_training), vocabulary), (7, 2))


@query("op6_circulant_minhash", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT z.doc_id, z.n AS n_shingles, min(r.y) AS component_id, z.doc_id = min(r.y) AS kept
FROM sizes z JOIN reach r ON r.x = z.doc_id GROUP BY z.doc_id, z.n
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document on two-word shingles."""
    found = minhash.near_duplicates(common.table(spark, folder, "documents", "doc_id", "text"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_splitting_tree", r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
    ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS most FROM sums),
levels AS (
  SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS place,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lvl FROM ranked),
common_level AS (SELECT lvl FROM levels WHERE most >= w * lvl ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, least(most, w * coalesce((SELECT lvl FROM common_level), 0.0)) AS target FROM levels),
laid AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS lim,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS a
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(greatest(0, least(lim, a + size) - a) + greatest(0, least(lim, source_size + a + size) - source_size - a)
    + greatest(0, least(lim, 2 * source_size + a + size) - 2 * source_size - a) AS BIGINT) AS taken
FROM laid
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the mix takes."""
    documents = common.table(spark, folder, "documents", "doc_id", "source", "text")
    rows = common.materialise(documents.select("doc_id", "source", mixing.word_count("text").alias("size")), "mixing-sizes")
    taken = mixing.taken_words(rows)
    return taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op8_cost_balanced_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(common.table(spark, folder, "documents", "doc_id", "text"), public_ranks())


def public_ranks() -> str:
    """The public vocabulary on this machine; every executor has the same installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op9_va_file", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1),
    lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM best WHERE rank <= 5
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Five best vectors of every query vector."""
    vectors = common.table(spark, folder, "embeddings", "vec_id", "embedding")
    return vafile.top_k(vectors.select("vec_id", vafile.scaled("embedding").alias("v")), F.col("vec_id") % 50 == 0, 5)


@query("op10_licence_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases, tags and expressions of every document."""
    documents = common.table(spark, folder, "documents", "doc_id", "text")
    found = documents.select("doc_id", licences.scanned("text").alias("s"))
    return found.select("doc_id", *[F.col("s")[c].alias(c) for c in (
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "alternatives")])


@query("op11_sorted_list_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent form and root of every word, from words one edit apart."""
    return variants.variants(common.table(spark, folder, "documents", "doc_id", "text"))


@query("op12_minimum_cut_text")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = common.table(spark, folder, "pages", "page_id", "url", "html")
    return mincut.extract(pages, mincut.fit(pages))


@query("op13_block_matrix_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened leading components of every vector."""
    return whitening.whiten(common.table(spark, folder, "embeddings", "vec_id", "embedding"))
