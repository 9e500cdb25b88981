"""Spelling variants against a plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import corpus
import pytest

from aeroframe.llm import queries, variants


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows, length=7, least=2, times=10):
    n = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = corpus.lower(word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += len(word) >= length
    n = {w: k for w, k in n.items() if k >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(((-n[x], x) for x in near[w] if n[x] >= times * n[w]), default=(0, None))[1] for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(frame):
    rows = frame.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_every_list_walk_finds_the_words_one_edit_away():
    dice = random.Random(5)
    for turn in range(400):
        words = sorted({"".join(dice.choices("ab" if turn % 2 else "abc", k=dice.randint(1, 8))) for _ in range(dice.randint(1, 60))})
        ordered = variants.SortedList(words)
        for i, w in enumerate(words):
            assert [words[j] for j in ordered.near(i)] == [x for x in words[i + 1:] if one_edit(w, x)]


def test_every_pair_is_reported_by_one_list():
    dice = random.Random(6)
    for _ in range(3000):
        a = "".join(dice.choices("abc", k=dice.randint(7, 19)))
        k = dice.randrange(len(a))
        b = dice.choice((a[:k] + a[k + 1:], a[:k] + dice.choice("abc") + a[k + 1:], a[:k] + dice.choice("abc") + a[k:]))
        if a == b:
            continue
        short, open_, seen = min(len(a), len(b)), [(0, 0)], 0
        while open_:                                   # all lists that can be dealt, stopping at any depth
            f, k = open_.pop()
            left = short - f - k
            if left <= 1:
                continue
            half = left // 2 if f + k == 0 else max(1, left // 2)
            children = [(f + half, k), (f, k + left - half)]
            hits = [c for c in children if variants.first_list(a, b, short, *c)]
            assert len(hits) == 1 and a[:hits[0][0]] == b[:hits[0][0]] and (not hits[0][1] or a[-hits[0][1]:] == b[-hits[0][1]:])
            open_, seen = hits, seen + 1
        assert seen


@pytest.mark.parametrize("list_words", [3, 500])
def test_words_forms_and_roots(spark, list_words):
    dice = random.Random(7)
    stems = ["".join(dice.choices("abcde\u00e9", k=8)) for _ in range(6)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = dice.choice(stems[:1 + i % 6])
            for _ in range(dice.choice((0, 0, 0, 0, 0, 0, 0, 1, 2))):
                k = dice.randrange(len(w))
                w = dice.choice((w[:k] + w[k + 1:], w[:k] + dice.choice("abc\u00e9") + w[k + 1:], w[:k] + dice.choice("abz") + w[k:]))
            words.append(w.upper() if dice.random() < 0.1 else w)
        rows.append((i if i % 3 else 7 if i % 2 else None, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "x" * 300_000), (4, "x" * 299_999 + "y"), (3, "x" * 300_000), (4, "x" * 299_999 + "y"), (5, "\u00d7" * 9 + "\u0100" + "\u00d7" * 9)]
    got = found(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), list_words=list_words))
    assert got == brute(rows)
    assert any(r[0] and r[1] != r[0] for r in got.values())


def test_query(spark, tmp_path):
    rows = corpus.write(str(tmp_path))
    assert found(queries.QUERIES["op11_sorted_list_variants"](spark, str(tmp_path))) == brute([r[:2] for r in rows])
