"""Statistics of one text, computed on word numbers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
          "n_digits", "n_distinct", "n_top", "n_adjacent", "n_shouts")
FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "line_words", "capitals", "marks", "digits",
            "distinct", "top_word", "adjacent", "shouts")
_BLANK = b" \t\n\r\x0b\x0c"
_BLANK_TEXT = " \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
WINDOW = 8


def repeated_window_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` (8) words that occur twice or more, first occurrence included."""
    n = len(ids)
    if n <= size:
        return 0
    width = int(ids.max()) + 1
    pairs = ids[:-1] * width + ids[1:]
    order = np.sort(pairs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # a window can only repeat where all its pairs do
    at = np.minimum(np.searchsorted(twice, pairs), len(twice) - 1)
    bad = np.concatenate(([0], np.cumsum(twice[at] != pairs)))
    if (bad[size - 1:] == bad[:n - size + 1]).sum() < 2:
        return 0
    grown, step = ids, 1
    while step < size:                        # numbers of 1-, 2-, 4-, 8-word windows
        key = grown[:-step] * (int(grown.max()) + 1) + grown[step:]
        grown = np.unique(key, return_inverse=True)[1]
        step *= 2
    starts = np.flatnonzero(np.bincount(grown)[grown] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + size] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS; all zero for a null or empty text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    size = len(raw)
    words = raw.split()                       # splits at exactly the ASCII blanks
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(_BLANK_TEXT)]
    return (
        n, len(text) - (size - len(raw.translate(None, _BLANK))), size - len(raw.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)), repeated_window_words(ids), len(lines),
        size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, b".,;:?")),
        size - len(raw.translate(None, b"0123456789")), len(number), int(np.bincount(ids).max()),
        int((ids[1:] == ids[:-1]).sum()), raw.count(b"!"))


def features(c: np.ndarray) -> np.ndarray:
    """Rows of COUNTS to rows of FEATURES; every share is relative to what it counts."""
    (n, chars, symbols, dup, repeat, lines, upper, marks, digits, distinct, top, adjacent, shouts) = np.asarray(c, float).T
    w, ch, ln = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([n, chars / w, symbols / ch, dup / ln, repeat / w, n / ln, upper / ch, marks / w, digits / ch,
                     distinct / np.sqrt(w), top / w, adjacent / w, shouts / w], axis=1)


def _count_rows(texts: pa.Array) -> np.ndarray:
    return np.array([counts(x) for x in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))


_STRUCT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]
                       + [T.StructField(f, T.DoubleType()) for f in FEATURES])


def statistics(text: Column | str) -> Column:
    """Struct of COUNTS and FEATURES of a text column.

    Nondeterministic only in name: it keeps Spark from evaluating the function once per use.
    """

    @F.arrow_udf(_STRUCT)
    def measure(texts: pa.Array) -> pa.Array:
        c = _count_rows(texts)
        f = features(c)
        return pa.StructArray.from_arrays([pa.array(x) for x in c.T] + [pa.array(x) for x in f.T], names=[*COUNTS, *FEATURES])

    return measure.asNondeterministic()(text)
