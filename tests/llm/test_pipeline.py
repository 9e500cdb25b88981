"""The pipeline's stages on tables with all odd cases, against brute force."""

from __future__ import annotations

from collections import Counter

import corpus
import pytest

import corpus_pipeline
from aeroframe.llm import common
from test_queries import brute_components, brute_targets


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    corpus.write(folder)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = common.materialise(stage(spark, docs, folder), name)
    return folder, out


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    _, out = stages
    for name in list(out)[:-1]:
        assert out[name].dtypes == out["input"].dtypes, name


def test_filters_keep_clean_documents(stages):
    _, out = stages
    for name in ("quality_rules", "quality_classifier"):
        ids = {r[0] for r in out[name].select("doc_id").collect()}
        assert set(range(60)) <= ids and not ids & set(range(60, 90)), name
    assert not pairs(out["quality_classifier"]) - pairs(out["quality_rules"])


def test_one_document_of_each_group_stays(stages):
    _, out = stages
    before = [(r["doc_id"], r["text"]) for r in out["quality_classifier"].select("doc_id", "text").collect()]
    _, root = brute_components(before, 5)
    after = Counter(r[0] for r in out["near_dedup"].select("doc_id").collect())
    assert {d for d in after if d is not None} == set(root.values())
    assert all(n == 1 for d, n in after.items() if d is not None)
    assert after[None] == sum(d is None for d, _ in before)


def test_mix_meets_its_targets(stages):
    _, out = stages
    sizes, got, largest = Counter(), Counter(), Counter()
    for r in out["near_dedup"].select("text", "source").collect():
        n = len(corpus.words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    whole = pairs(out["near_dedup"])
    for r in out["mix_sources"].select("doc_id", "text", "source", "n_chars").collect():
        got[r["source"]] += len(corpus.words(r["text"]))
        assert (r["doc_id"], r["text"]) in whole and r["n_chars"] == len(r["text"])
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
    assert max(Counter(r[0] for r in out["mix_sources"].where("doc_id is not null").select("doc_id").collect()).values()) <= 3


def test_an_id_on_several_texts_loses_none(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(a)), (6, " ".join(a)), (7, " ".join(b) + " more"), (8, ""), (8, " "), (8, None), (9, "word " * 1_000_000), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, _tag string, n_chars int")
    got = pairs(corpus_pipeline.near_dedup(spark, docs, ""))
    assert got == Counter({(5, " ".join(a)): 1, (5, " ".join(b)): 1, (8, ""): 1, (8, " "): 1, (9, "word " * 1_000_000): 1, (None, "x"): 2})


def test_run_gives_the_same_as_the_stages(spark, stages):
    folder, out = stages
    a = out["pack_sequences"].groupBy("doc_id").sum("length").collect()
    b = corpus_pipeline.run(spark, folder).groupBy("doc_id").sum("length").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_table(spark, tmp_path):
    corpus.write(str(tmp_path), empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
