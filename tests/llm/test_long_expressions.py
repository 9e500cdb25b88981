"""Licence expressions of any length and with any ending keep all their licences."""

from __future__ import annotations

import itertools
import time

from aeroframe.llm import licences


def scan(expression: str) -> tuple:
    return licences.Scanner({}, {}).scan(f"SPDX-License-Identifier: {expression}\nrest")


def test_no_licence_is_lost_behind_a_cap():
    brackets = " AND ".join(f"(a{i} OR b{i})" for i in range(13))
    *_, labels, shown, score = scan(brackets)
    assert labels == ",".join(sorted(f"{x}{i}" for x in "ab" for i in range(13)))
    assert shown == f"more than 4096 sets of {brackets.lower()}" and score == 0.75
    *_, labels, shown, _ = scan(" OR ".join(f"n{i}" for i in range(100)))
    assert len(labels.split(",")) == len(shown.split(" or ")) == 100


def test_start_ends_at_the_first_unreadable_token():
    for text, want in (("MIT, see LICENSE", "mit"), ("MIT AND (X OR", "mit"), ("(MIT OR X), y", "mit,x"), (", MIT", ""), ("MIT_x", ""),
                       ("a WITH (b OR c)", "a"), ("(a OR b) WITH c", "a,b"), ("a WITH b, c", "a"), ("a WITH b AND b", "a,b")):
        assert scan(text)[5] == want, text


def test_start_is_the_longest_that_reads():
    for n in range(1, 6):
        for tokens in itertools.product(["a", "or", "with", "(", ")"], repeat=n):
            want: list = []
            for k in range(n, 0, -1):
                try:
                    want = licences.alternatives(" ".join(tokens[:k]))
                    break
                except ValueError:
                    continue
            assert licences.readable_start(" ".join(tokens)) == want, tokens


def test_long_expressions_stay_fast():
    start = time.perf_counter()
    hard = " AND ".join([f"(a{i} OR b{i})" for i in range(12)] + [f"c{i}" for i in range(20_000)])
    assert len(scan(hard)[5].split(",")) == 20_024
    assert len(scan(" OR ".join(f"c{i}" for i in range(20_000)))[5].split(",")) == 20_000
    assert time.perf_counter() - start < 20
