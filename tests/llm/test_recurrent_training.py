"""Training of the recurrent model reads every text of its fold, to the last token."""

from __future__ import annotations

import numpy as np

from aeroframe.llm import grulm


def _vocabulary():
    words = [b"a", b"b", b"c", grulm.END.encode()]
    return grulm.Vocabulary({w: 9 for w in words}, 40, 4, words, np.ones(grulm.RARE_CLASSES))


def test_lanes_read_every_token_once():
    v = _vocabulary()
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 3, n), v.end).astype(np.int16) for n in (0, 1, 5000, 31, 32, 33, *rng.integers(0, 900, 60))]
    lanes = grulm.Lanes(grulm.Network(v, hidden=4), v.grouping, v.end, 0.01, 4)
    for t in texts:
        lanes.add(t)
    lanes.close()
    assert lanes.tokens == sum(map(len, texts))
    # what is read: every token but the last of each lane, and the end before each lane
    assert lanes.read.sum() == lanes.tokens
    assert np.isfinite(lanes.network.flat()).all()


def test_late_texts_shape_the_network(spark):
    """3,000 texts in one order, and one source in only the last of many: its word order is learned too."""
    texts = ["a b c " * 3] * 2_900 + ["x y z " * 300] * 100
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    counted = grulm.common.materialise(grulm.count_words(documents), "counts")
    v = grulm.vocabulary(counted)
    coded = grulm.texts_of(grulm.encode(documents, v))
    seen = []
    whole, untrained = grulm.fit(coded, v), grulm.Model(v, grulm.Network(v))
    for model in (untrained, whole):
        s = np.append(model.symbols(grulm.words_of("x y z " * 30)), model.end)
        seen.append(model.log_likelihoods([s])[0] / len(s))
    assert seen[1] > seen[0] + 0.3, seen
    # no number of texts or tokens is cut: twice the rare source moves its parameters
    fewer = grulm.fit(coded.where("doc_id < 2950"), v)
    assert not np.allclose(fewer.network.flat(), whole.network.flat())
