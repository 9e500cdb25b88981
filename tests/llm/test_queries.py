"""Every registered corpus query on tables with all odd cases, against the definitions in plain Python."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest

from aeroframe.llm import queries

NAMES = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    return folder, corpus.write(folder)


@pytest.fixture(scope="module")
def empty_tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    corpus.write(folder, empty=True)
    return folder


def run(spark, tables, name):
    full = next(n for n in NAMES if n.startswith(name))
    return queries.QUERIES[full](spark, tables[0]).collect()


def same_ids(got, rows):
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() == 0


def test_language(spark, tables):
    got = run(spark, tables, "op1_")
    same_ids(got, tables[1])
    known = {r[0]: r for r in tables[1]}
    assert all(r["held_out"] == (r["doc_id"] is not None and corpus.remainder(r["doc_id"], 4) == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == known[r["doc_id"]][2] for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    blank = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {d for d, t, *_ in tables[1] if d is not None and not any(c.isalpha() for c in t or "")} == blank - {None}


def test_base_statistics_and_rules(spark, tables):
    got = run(spark, tables, "op2_")
    same_ids(got, tables[1])
    text = {r[0]: r[1] for r in tables[1] if r[0] is not None}
    for r in (r for r in got if r["doc_id"] is not None):
        t = text[r["doc_id"]] or ""
        w = corpus.words(t)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        inside = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if corpus.words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t) if w else 0, len(lines) - len(set(lines)), len(inside)), t[:40]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    by = {r["doc_id"]: r["kept"] for r in got}
    assert all(by[i] for i in range(60)) and not any(by[i] for i in range(60, 90))


def test_toxicity(spark, tables):
    got = run(spark, tables, "op3_")
    same_ids(got, tables[1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and corpus.remainder(r["doc_id"], 5) == 0) for r in got)


def test_quality(spark, tables):
    got = run(spark, tables, "op4_")
    same_ids(got, tables[1])
    assert all(r["held_out"] == (r["doc_id"] is not None and corpus.remainder(r["doc_id"], 3) == 1) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == 1 for i in range(60)) and all(by[i]["predicted"] == 0 for i in range(60, 90))


def test_language_model(spark, tables):
    got = run(spark, tables, "op5_")
    same_ids(got, tables[1])
    text = {r[0]: r[1] for r in tables[1]}
    tokens = {d: [*corpus.words(corpus.lower(t or "")), "\n"] for d, t in text.items()}
    c = Counter()
    for d, *_ in tables[1]:
        if d is not None and corpus.remainder(d, 7) != 2:
            c.update(tokens[d])
    n, v = sum(c.values()), len(c)
    for r in (r for r in got if r["doc_id"] is not None):
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["held_out"] == (corpus.remainder(r["doc_id"], 7) == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
        assert r["score"] < 0
    train = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in train) > sum(r["base_score"] for r in train)


def shingle_set(text, size):
    w = corpus.words(corpus.lower(text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute_components(rows, size):
    sets = {d: shingle_set(t, size) for d, t, *_ in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, {d: find(d) for d in ids}


def test_near_duplicates(spark, tables):
    got = run(spark, tables, "op6_")
    same_ids(got, tables[1])
    sets, root = brute_components(tables[1], 2)
    assert len(set(root.values())) < len(root) - 12
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (
                len(sets[r["doc_id"]]), root[r["doc_id"]], r["doc_id"] == root[r["doc_id"]])


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


def test_mix(spark, tables):
    got = run(spark, tables, "op7_")
    same_ids(got, tables[1])
    sizes, taken, seen = Counter(), Counter(), {}
    for _, t, _, s in tables[1]:
        sizes[s] += len(corpus.words(t))
    of = {r[0]: (len(corpus.words(r[1])), r[3]) for r in tables[1] if r[0] is not None}
    want = brute_targets(sizes)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            size, source = of[r["doc_id"]]
            assert (r["size"], r["source_size"]) == (size, sizes[source]) and r["target"] == pytest.approx(want[source], abs=1e-3)
            taken[source] += r["taken"]
            seen[source] = r["target"]
    for s in ("src0", "src1", "src3"):                 # sources without rows that lack an id
        assert abs(taken[s] - want[s]) <= 1
    again = run(spark, tables, "op7_")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_packing(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, tables, "op8_")
    copies = Counter((d, t) for d, t, *_ in tables[1] if d is not None)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for (d, t), n in copies.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[d], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == n * len(ids)
        covered = Counter(i for r in own for i in range(r["start"], r["start"] + r["length"]))
        assert set(covered.values()) == {n} and len(covered) == len(ids)
        for r in own:
            raw = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(raw) and r["doc_tokens"] == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    full = sum(r["length"] for r in got)
    assert full > 0.9 * 2048 * (len(sequences) - 1)


def test_top_k(spark, tables):
    import pyarrow.parquet as pq

    rows = {}
    for r in pq.read_table(f"{tables[0]}/embeddings.parquet").to_pylist():
        e = r["embedding"]
        if r["vec_id"] is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            rows[(r["vec_id"], tuple(math.floor(256 * x) for x in e))] = None
    want = []
    for q, v in rows:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in rows if i != q and len(x) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    got = run(spark, tables, "op9_")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_licences(spark, tables):
    got = run(spark, tables, "op10_")
    same_ids(got, tables[1])
    import re
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    text = {r[0]: r[1] for r in tables[1] if r[0] is not None}
    for r in (r for r in got if r["doc_id"] is not None):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", corpus.lower(text[r["doc_id"]] or ""))
        hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        places = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    tagged = next(r for r in got if r["doc_id"] == 121)
    assert tagged["labels"] == "apache-2.0,gpl-2.0-only,mit" and tagged["alternatives"] == (
        "apache-2.0+gpl-2.0-only with classpath-exception-2.0 or gpl-2.0-only with classpath-exception-2.0+mit")
