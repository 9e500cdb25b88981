"""Hidden words of every kind and length reach the lattice."""

from __future__ import annotations

import time

import numpy as np
import pytest

from aeroframe.llm import toxicity

WORDS = "you are a stupid worthless idiot kill ass loser moron the times nothing to hide the you are a".split()


@pytest.fixture(scope="module")
def decoder():
    counts, table = np.zeros(64 ** 3, np.int64), toxicity._classes()
    text = " ".join(WORDS * 40) + "!! " + ", ".join(WORDS * 5) + "! 1990s, 42 "
    code = table[np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32)].astype(int)
    np.add.at(counts, (code[:-2] << 12) | (code[1:-1] << 6) | code[2:], 1)
    return toxicity.Decoder(toxicity.letter_model(counts))


def test_look_alikes_at_the_end(decoder):
    for hidden, want in (("id10+", "idiot"), ("1d107", "idiot"), ("idi07", "idiot"), ("a55", "ass"), ("ki11", "kill"), ("1053r", "loser"),
                         ("w0r7hl355", "worthless"), ("1d10t", "idiot"), ("id10t!", "idiot!")):
        assert decoder.restore(f"you {hidden} you") == f"you {want} you", hidden
    assert decoder.restore("the!! times! hide! 42") == "the!! times! hide! 42"


def test_spaced_words_stay_words(decoder):
    assert decoder.restore("y o u i d i o t") == "you idiot"
    assert decoder.restore("y o u a r e a s t u p i d w o r t h l e s s i d i o t") == "you are a stupid worthless idiot"


def test_long_stretches_are_read_in_windows(decoder, monkeypatch):
    assert decoder.restore("i" * 60 + "diot") in ("idiot", "iidiot")
    assert decoder.restore("moron" + "n" * 48) in ("moron", "moronn")
    spaced = " ".join("youareastupidworthlessidiot" * 12)
    whole = decoder.restore(spaced)
    assert whole.count("idiot") == 12 and " idiot " in whole
    monkeypatch.setattr(toxicity, "_WINDOW", 10 ** 9)
    assert decoder.viterbi(spaced.replace(" ", ""), True)[1] == whole


def test_doubled_letters(decoder):
    assert decoder.restore("iiddiioott") == "idiot"
    assert decoder.restore("committee bookkeeper mississippi balloon") == "committee bookkeeper mississippi balloon"


def test_long_input_stays_fast(decoder):
    start = time.perf_counter()
    for text in ("a" * 200_000, "!" * 200_000, "ab" * 100_000, "a1" * 50_000, "a " * 50_000, "1" * 100_000 + "a"):
        decoder.restore(text)
    assert time.perf_counter() - start < 30
