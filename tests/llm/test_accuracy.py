"""Held-out accuracy of the learned operators on the given tables."""

from __future__ import annotations

import os

import pytest

from aeroframe.llm import queries

FOLDER = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.01")


def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op1_rank_profiles"](spark, FOLDER).where("held_out")
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    right, n = got.join(truth, "doc_id").selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert right / n > 0.98


@pytest.mark.parametrize("name, label, floor", [("op3_deobfuscated_toxicity", "toxic", 0.9), ("op4_pairwise_additive", "quality", 0.95)])
def test_labels_of_held_out_documents(spark, name, label, floor):
    got = queries.QUERIES[name](spark, FOLDER).where("held_out")
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet")
    right, n = got.join(truth, "doc_id").selectExpr(f"sum(int(predicted = {label}))", "count(*)").first()
    assert right / n >= floor


def test_rules_reject_bad_and_keep_good(spark):
    got = queries.QUERIES["op2_decision_list"](spark, FOLDER).where("not base_failed")
    rows = {(r["quality"], r["kept"]): r["count"] for r in got.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
            .groupBy("quality", "kept").count().collect()}
    assert rows.get((1, False), 0) <= 0.02 * rows[1, True]
    assert rows.get((0, False), 0) >= 20 and rows.get((0, True), 0) <= 8


def test_recurrent_model_beats_the_base_on_held_out_texts(spark):
    got = queries.QUERIES["op5_gated_recurrent"](spark, FOLDER).where("held_out")
    score, base, n = got.selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert (score - base) / n > 0.25
