"""The methods themselves, away from Spark where they allow it."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from aeroframe.llm import (
    decision_list, ga2m, grulm, langid, licences, minhash, mixing, packing, shingles, textstats, toxicity, vafile,
)


def test_profile_ranks_are_counts_of_grams():
    text = "Aba, aba!  bé"
    padded = [" " + w + " " for w in ("aba", "aba", "bé")]
    want = Counter(w[i:i + n] for w in padded for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i:i + n] != " ")
    keys, n = np.unique(langid.grams(text), return_counts=True)
    assert sorted(n.tolist()) == sorted(want.values())


def test_out_of_place_distance_prefers_own_profile():
    a, b = langid.ranked("the thin thing that thinks"), langid.ranked("der dünne dinge denker dort")
    p = langid.Profiles({"en": a, "de": b})
    assert p.predict("the thin thing that thinks") == ("en", 1.0)
    assert p.predict("dort der denker")[0] == "de"
    assert p.predict(None) == p.predict("123 !") == ("und", 0.0)


def test_repeated_windows_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(3) for _ in range(rng.randrange(0, 60))]
        seen = Counter(tuple(ids[i:i + 8]) for i in range(len(ids) - 7))
        want = {i + k for i in range(len(ids) - 7) if seen[tuple(ids[i:i + 8])] > 1 for k in range(8)}
        assert textstats.repeated_window_words(np.array(ids, np.int64)) == len(want)


def _data(n=3000):
    rng = np.random.default_rng(5)
    x = rng.random((n, len(textstats.FEATURES)))
    return x, rng


def test_decision_list_finds_a_conjunction():
    x, rng = _data()
    bad = (x[:, 2] > 0.7) & (x[:, 6] <= 0.4) | (x[:, 4] > 0.9)
    rules = decision_list.learn(x, bad)
    fired = np.zeros(len(x), bool)
    for r in rules:
        fired |= decision_list._covers(r, x)
    assert (fired == bad).mean() > 0.98
    assert decision_list.learn(x, np.zeros(len(x), bool)) == []


def test_additive_model_needs_and_finds_an_interaction():
    x, rng = _data()
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    with_pairs, without = ga2m.learn(x, y), ga2m.learn(x, y, n_pairs=0)
    fresh = rng.random((2000, x.shape[1]))
    want = (fresh[:, 0] > 0.5) ^ (fresh[:, 3] > 0.5)
    assert ((with_pairs.score(fresh) >= 0.5) == want).mean() > 0.85 > ((without.score(fresh) >= 0.5) == want).mean()
    assert (0, 3) in with_pairs.pairs
    assert ga2m.learn(x[:0], y[:0]).score(x[:2]) == pytest.approx([0.5, 0.5])


def test_decoder_restores_hidden_words():
    counts = np.zeros(64 ** 3, np.int64)
    table = toxicity._classes()
    for w in ["idiot"] * 50 + ["the", "meet", "moron", "little", "other", "tool", "toast", "loser"] * 30:
        code = table[np.frombuffer(f"  {w}  ".encode("utf-32-le"), np.uint32)].astype(int)
        np.add.at(counts, (code[:-2] << 12) | (code[1:-1] << 6) | code[2:], 1)
    d = toxicity.Decoder(toxicity.letter_model(counts))
    assert d.restore("you 1d10t") == "you idiot"
    assert d.restore("an i d i o t here") == "an idiot here"
    assert d.restore("Idiiiiiot m0r0n l0$er") == "idiot moron loser"
    assert d.restore("nothing to hide, 42 times!") == "nothing to hide, 42 times!"
    assert d.restore(None) == d.restore("") == ""
    best = max(((d.literal(a + "d" + b + "ot"), a + "d" + b + "ot") for a in "il" for b in "il"))[1]
    assert d.viterbi("1d1ot")[1] == best


def test_recurrent_model_is_a_distribution_and_learns():
    words = [b"a", b"b", b"c", grulm.END.encode()]
    counts = {w: 50 - i for i, w in enumerate(words)}
    rare = np.ones(grulm.RARE_CLASSES)
    rare[grulm.rare_class(b"zz")] += 3
    v = grulm.Vocabulary(counts, sum(counts.values()) + 2, 5, words, rare)
    m = grulm.Model(v, grulm.Network(v))
    h = np.random.default_rng(0).normal(size=(1, grulm.HIDDEN)).astype(np.float32)
    symbols = np.arange(v.symbols)
    p = np.exp(m.network.log_probs(np.repeat(h, len(symbols), 0), symbols, v.class_of(symbols)))
    assert p.sum() == pytest.approx(1, abs=1e-5)
    text = m.symbols([b"a", b"b", b"c"] * 30 + [grulm.END.encode()])
    before = m.log_likelihoods([text])[0]
    lanes = grulm.Lanes(m.network, v.grouping, v.end, 0.01, 4)
    for _ in range(480):
        lanes.add(text.astype(np.int16))
    lanes.close()
    assert m.log_likelihoods([text])[0] > before / 3
    # windows and company do not change a text's likelihood
    one_by_one, h = 0.0, np.zeros((1, grulm.HIDDEN), np.float32)
    last = np.array([m.end])
    for s in text:
        h = m.network.step(last, h)
        one_by_one += m.network.log_probs(h, np.array([s]), v.class_of(np.array([s])))[0]
        last = np.array([s])
    mixed = m.log_likelihoods([text[:1], text, text[:40], np.zeros(0, np.int64)])
    assert mixed[1] == pytest.approx(one_by_one, rel=1e-4) and mixed[3] == 0


def test_gradients_match_differences():
    words = [b"a", b"b", b"c", grulm.END.encode()]
    v = grulm.Vocabulary({w: 9 for w in words}, 40, 4, words, np.ones(grulm.RARE_CLASSES))
    net = grulm.Network(v, hidden=3)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    part = np.array([[0, 1, 2, 3, 5], [3, 2, 6, 0, 0]])
    h0 = np.zeros((2, 3))

    def loss():
        h, total = h0, 0.0
        for t in range(4):
            h = net.step(part[:, t], h)
            total -= net.log_probs(h, part[:, t + 1], v.class_of(part[:, t + 1])).sum()
        return total / 8

    grads, _ = net._window(part, h0, v)
    rng = np.random.default_rng(1)
    for k in net.NAMES:
        a = getattr(net, k)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in a.shape)
            if k in ("out_w", "bias_w") and at[-1] >= len(words):
                continue
            old = a[at]
            a[at] = old + 1e-5
            up = loss()
            a[at] = old - 1e-5
            down = loss()
            a[at] = old
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5), k


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    got = []
    for _ in range(60):
        base = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
        other = np.concatenate((base[:800], rng.integers(0, 2 ** 63, 100).astype(np.uint64)))
        got.append((minhash.signature(base) == minhash.signature(other)).mean())
    assert np.mean(got) == pytest.approx(0.8, abs=0.02)


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array(["", "A b  C", "x" * 300 + " y z", None, " lead tail ", "é É\n\tq", "w " * 500])
    whole = [s.tolist() for n in (2, 5) for s in shingles.sets(texts.fill_null(""), n)]
    monkeypatch.setattr(shingles, "_CHUNK", 16)
    assert whole == [s.tolist() for n in (2, 5) for s in shingles.sets(texts.fill_null(""), n)]
    a, b = list(shingles.sets(pa.array(["one Two three", "ONE two  three four"]), 2))
    assert shingles.count_common(a.tobytes(), b.tobytes()) == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    loops = {a for a, b in edges if a == b}
    assert {r["id"]: r["component"] for r in got} == {k: v for k, v in root.items() if k not in loops or any(k in e for e in edges if e[0] != e[1])}


def test_families_without_a_common_leader_are_still_joined(spark):
    """A chain of texts, each close to the next only."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        w = list(words)
        for j in range(i):
            w[(j * 4) % 120] = f"new{j}"
        rows.append((500 - i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()
    assert {r["component_id"] for r in got} == {471}


def test_splitting_tree_gives_every_block_once():
    quotas = np.array([17, 0, 230, 5])
    for shards in (1, 2, 7, 16):
        parts = [mixing.shard_quotas(quotas, shards, j, 7) for j in range(shards)]
        at = np.zeros(4, np.int64)
        for first, n in parts:
            assert (first == at).all()
            at += n
        assert (at == quotas).all()
        sizes = [int(n.sum()) for _, n in parts]
        assert max(sizes) - min(sizes) <= 1


def test_first_words_keep_their_blanks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a\tb \n c  ", 2), ("a", 1), ("a b", 5)], "t string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a\tb", "a", "a b"]


def test_balance_keeps_capacity_and_evens_out_cost():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 2048) for _ in range(900)]
    pieces = packing.balance(lengths)
    used, cost, whole = Counter(), Counter(), Counter()
    for k, start, n, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used[s]
        used[s] += n
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
        whole[k] += n
    assert max(used.values()) <= 2048 and [whole[k] for k in range(900)] == lengths
    assert sum(lengths) > 0.98 * 2048 * len(used)
    spread = np.array(list(cost.values()))
    assert spread.std() / spread.mean() < 0.35
    assert packing.balance([]) == []


def test_token_ids_are_those_of_the_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = ["".join(rng.choice([" ", "\n", "a", "B", "'s", ".", "\t", "é", "12", "  ", "\x1c", "😀"]) for _ in range(14)) for _ in range(800)]
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(ids.of(t), "<u4").tolist() for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_approximation_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    v = rng.normal(0, 100, (2000, 16)).astype(np.int64)
    q = rng.normal(0, 100, (20, 16)).astype(np.int64)
    near = vafile.Approximation(v)
    lower, upper = near.bounds(q.astype(float))
    exact = 2 * q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()
    ids = np.arange(2000)
    for j in range(20):
        got, scores, read = near.best(q[j], ids == j, lower[j], upper[j], ids, 5)
        want = sorted((-int(s), i) for i, s in enumerate(exact[j] // 2) if i != j)[:5]
        assert [(-s, i) for i, s in zip(got.tolist(), scores.tolist())] == want
        assert read < 200


def test_large_components_stay_exact(spark):
    big = 3.0e30
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", vafile.scaled("e").alias("v"))
    got = vafile.top_k(df, df["vec_id"] == 0, 5).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 3), (3, 2)]
    assert max(r["score"] for r in got) == 2 ** 63 - 1


def test_expressions():
    assert licences.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licences.alternatives("(A OR b) AND c") == [frozenset({"a", "c"}), frozenset({"b", "c"})]
    for broken in ("", "or", "a or", "a b", "(a", "a)", "a with (b or c)", "()"):
        with pytest.raises(ValueError):
            licences.alternatives(broken)
    assert licences.readable_start("MIT or") == [frozenset({"mit"})]


def test_scan_counts_overlapping_places():
    s = licences.Scanner({"a b": "x", "b a": "y", "a b a": "z"}, {})
    n_words, n_base, first, last, base, *_ = s.scan("A b a-b c")
    assert (n_words, n_base, first, last, base) == (5, 4, 0, 2, "x,y,z")
    assert s.scan(None)[:5] == (0, 0, None, None, "")
    assert math.isclose(licences.Scanner().scan("mit license")[7], 0.5)
