"""Minimum-cut extraction: known pages, and cuts against all labellings."""

from __future__ import annotations

import random
from collections import Counter

import corpus

from aeroframe.llm import mincut, queries


def cost(odds, ties, side):
    return (sum(o for o, s in zip(odds, side) if o > 0 and not s) + sum(-o for o, s in zip(odds, side) if o < 0 and s)
            + sum(c for a, b, c in ties if side[a] != side[b]))


def test_no_labelling_costs_less_than_the_cut():
    dice = random.Random(3)
    for _ in range(300):
        n = dice.randint(1, 8)
        odds = [dice.choice((-2.0, -1.0, 0.0, 0.5, 1.0, dice.uniform(-3, 3))) for _ in range(n)]
        ties = [(a, b, dice.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if dice.random() < 0.5]
        least = min(cost(odds, ties, [bool(s >> i & 1) for i in range(n)]) for s in range(1 << n))
        assert abs(cost(odds, ties, mincut.cut(odds, ties)) - least) < 1e-6
        near = [{} for _ in range(n)]
        for a, b, c in ties:
            near[a][b] = near[b][a] = c
        assert abs(cost(odds, ties, mincut._max_flow(list(range(n)), odds, near)) - least) < 1e-6


def test_long_chains_are_cut():
    odds = [0.4 if i % 3 else -0.7 for i in range(30_000)]
    side = mincut.cut(odds, [(i, i + 1, 1.0) for i in range(len(odds) - 1)])
    assert len(set(side)) == 1


def test_pages(spark, tmp_path):
    corpus.write(str(tmp_path))
    got = queries.QUERIES["op12_minimum_cut_text"](spark, str(tmp_path)).collect()
    assert got and all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got) == Counter((p, u, t) for p, u, _, t in corpus.PAGES)


def test_articles_of_the_given_pages(spark, folder):
    import html
    import re
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.QUERIES["op12_minimum_cut_text"](spark, folder).collect():
        inside = re.search("<article>(.*?)(?:</article>|$)", source[r["page_id"]], re.S)[1].replace("<br>", " ")
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in lines if x)


def test_text_decides_where_markup_says_nothing():
    menu = "".join(f"<div><a href='/{i}'>Topic {i}</a></div>" for i in range(8))
    body = "".join(f"<div>{corpus._LONG} {i}.</div>" for i in range(5))
    got = mincut.content(f"<body><div>{menu}</div><div>{body}<div>Yes.</div></div></body>", mincut.TextModel())
    assert got == [f"{corpus._LONG} {i}." for i in range(5)] + ["Yes."]


def test_the_model_learns_from_counts():
    counted = [((0, 0, 1, 0, 0), 90, 1), ((4, 0, 0, 0, 0), 1, 80), ((1, 3, 0, 2, 0), 0, 50)]
    model = mincut.TextModel.learned(counted)
    assert model.logit((0, 0, 1, 0, 0)) > 1 and model.logit((4, 0, 0, 0, 0)) < 0 and model.logit((1, 3, 0, 2, 0)) < -1
    assert mincut.TextModel.learned([]).logit((5, 0, 1, 0, 0)) > 0 > mincut.TextModel.learned([]).logit((0, 3, 0, 2, 0))
