"""Families of texts that are alike below the threshold, and ids that stand on several texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from aeroframe.llm import minhash


def edited(dice, base, share, words):
    return [dice.choice(words) if dice.random() < share else w for w in base]


def brute(texts, size=1):
    """Smallest number reachable over links, by an inverted index."""
    sets = [frozenset(tuple(t[i:i + size]) for i in range(len(t) - size + 1)) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def counting(monkeypatch):
    compared = []
    linked = minhash.linked

    def watched(pairs, sets, percent=minhash.PERCENT):
        compared.append(pairs.count())
        return linked(pairs, sets, percent)

    monkeypatch.setattr(minhash, "linked", watched)
    return compared


def test_a_large_family_below_the_threshold_costs_few_comparisons(spark, monkeypatch):
    dice = random.Random(8)
    base, words = [f"w{i}" for i in range(150)], [f"x{i}" for i in range(20_000)]
    texts = [edited(dice, base, dice.choice((0.02, 0.05, 0.1, 0.14, 0.18, 0.25)), words) for _ in range(2_000)]
    # some share their edits, so that they are linked to each other and not to the base
    for i in range(0, 200, 4):
        far = edited(dice, base, 0.3, words)
        texts += [edited(dice, far, 0.05, words) for _ in range(3)]
    compared = counting(monkeypatch)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), size=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(brute(texts)))
    assert sum(compared) < 60 * len(texts)         # of 1,000 times as many pairs


def test_texts_alike_to_each_other_without_any_link(spark, monkeypatch):
    dice = random.Random(9)
    core = [f"w{i}" for i in range(110)]
    texts = [core + [f"own{i}x{j}" for j in range(40)] for i in range(1_000)]
    for t in texts:
        dice.shuffle(t)
    compared = counting(monkeypatch)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    assert sum(compared) < 40 * len(texts)


def test_pairs_just_above_the_threshold_are_found(spark):
    dice = random.Random(10)
    rows, n = [], 400
    for i in range(n):
        t = [f"t{i}w{j}" for j in range(180)]
        other = list(t)
        for k in dice.sample(range(180), 20 - i % 5):           # 160 of 200 common words and a few more
            other[k] = f"t{i}y{k}"
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(other))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - d % 2 for d, _ in rows}


def test_an_id_on_several_texts_keeps_all_their_links(spark):
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a[:98], "z"])), (8, " ".join([*b[:98], "y"])), (9, "other words here"), (9, "other words here")]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect())
    assert got == Counter({(5, 5, True): 2, (7, 5, False): 1, (8, 5, False): 1, (9, 9, True): 2})


def test_parities_exclude_no_pair_at_the_threshold(spark):
    dice = np.random.default_rng(11)
    rows = []
    for n in (1, 4, 9, 45, 180, 900, 9_000, 90_000):
        for spare in range(-2, 3):                              # common of united is 0.8, or as near as sizes allow
            common_ = dice.integers(0, 2 ** 63, max(n * 4 // 5 + spare, 0))
            own = dice.integers(0, 2 ** 63, max(n - len(common_), 0))
            cut = dice.integers(0, len(own) + 1)
            a, b = (np.unique(np.concatenate((common_, x))) for x in (own[:cut], own[cut:]))
            rows.append((a.tobytes(), b.tobytes(), len(a), len(b)))
    pairs = spark.createDataFrame(rows, "a binary, b binary, na long, nb long")
    told = pairs.withColumns({"pa": minhash._parities("a"), "pb": minhash._parities("b")})
    for r in told.select("a", "b", minhash._may_link("pa", "pb", "na", "nb", 80).alias("may")).collect():
        both = len(np.intersect1d(np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)))
        linked = 100 * both >= 80 * ((len(r["a"]) + len(r["b"])) // 8 - both)
        assert r["may"] or not linked


def test_texts_that_share_frequent_edits_are_told_apart_by_parities(spark, monkeypatch):
    dice = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    # edits from a short list: most texts meet in some of them, few are alike
    texts = [edited(dice, base, 0.2, [f"x{i}" for i in range(60)]) for _ in range(1_000)]
    compared = counting(monkeypatch)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), size=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(brute(texts)))
    assert sum(compared) < 60 * len(texts)
