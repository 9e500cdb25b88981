"""Toxicity scores on deobfuscated text.

Noisy channel: a writer takes a clean word and hides it by lookalike characters (1d10t), by spacing
(i d i o t) or by repetition (idiiiot, iiddiioott). Every suspicious stretch becomes a lattice of the letters each
character may stand for; a Viterbi search over a character trigram model of the corpus finds the most
probable clean reading, whatever its length: the states run on through windows. Stretches with a single reading need no search. The restored text is scored by
word beginnings and whole words that labelled toxic texts share, found by one Aho-Corasick pass, and a
logistic curve fitted on other labelled texts.

The character model counts every text of the training fold. Labels come from a bounded sample, halved:
one half chooses the marks, the other fits the curve.

Defined results: null and empty texts score like a text without marks; with no toxic or no clean label
in the sample all texts get the smoothed share of toxic labels; repeated documents count each time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aeroframe.llm import common

MAX_TRAINING_ROWS = 20_000
MAX_MARKS = 5_000
# fixed values: what a character may stand for
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
              "|": "il", "+": "t"}
_SUBSTITUTED = -1.0             # log probabilities of the channel per hidden character
_REPEATED = -0.5
_SPACED_OUT = -2.0
_FIRST_ACCENT = 0xDF
_CLASSES = 64                   # 0 blank, 1-26 a-z, 27-59 accented Latin letters, 60 other letters
_BLANK, _OTHER = 0, 60
_SIGNS = re.escape("".join(LOOKALIKES))
_LETTER = r"[^\W\d_]"
_EITHER = rf"(?:{_LETTER}|[{_SIGNS}])"
# letters with look-alikes before, between or behind them
_HIDDEN = re.compile(rf"(?<![^\W_])(?<![{_SIGNS}])(?:{_LETTER}+[{_SIGNS}]|[{_SIGNS}]+{_LETTER}{_EITHER}|[{_SIGNS}]{{2,}}{_LETTER}){_EITHER}*")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ ._-][^\W_]){2,}(?!\w)")
# one letter three times, or two letters in a row doubled
_RUN = re.compile(rf"({_LETTER})\1(?:\1|({_LETTER})\2)")
_LONG_RUN = re.compile(rf"(?<!{_LETTER}){_LETTER}*?({_LETTER})\1(?:\1|({_LETTER})\2){_LETTER}*")
_EQUAL = re.compile(r"(.)\1*", re.DOTALL)
_WINDOW = 64                    # columns after which the reading common to all states is settled
_CACHED = 48                    # longest stretch that is remembered
_KEPT = 50_000


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = _OTHER
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    for c in range(_FIRST_ACCENT, 0x100):
        if chr(c).isalpha():
            out[c] = 27 + c - _FIRST_ACCENT
    return out


def count_trigrams(documents: DataFrame) -> DataFrame:
    """(key, n): letter class trigrams of all texts; at most 64 ** 3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = _classes(), np.zeros(_CLASSES ** 3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                code = classes[np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le"), np.uint32)].astype(np.int32)
                key = (code[:-2] << 12) | (code[1:-1] << 6) | code[2:]
                if len(key) > _CLASSES ** 2:
                    total += np.bincount(key, minlength=_CLASSES ** 3)
                else:
                    np.add.at(total, key, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["key", "n"])

    counted = documents.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def letter_model(counts: np.ndarray) -> np.ndarray:
    """log P(letter | two before), interpolated with shorter contexts; shape 64 x 64 x 64."""
    three = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _CLASSES)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3)


class Decoder:
    """Restores hidden words of a text."""

    def __init__(self, model: np.ndarray):
        self._model = model
        self._known: dict[str, str] = {}

    @staticmethod
    def _class(c: str) -> int:
        if "a" <= c <= "z":
            return ord(c) - 96
        if _FIRST_ACCENT <= ord(c) < 0x100 and c.isalpha():
            return 27 + ord(c) - _FIRST_ACCENT
        return _OTHER if c.isalpha() else _BLANK

    def lattice(self, stretch: str, spaced: bool = False) -> Iterator[list[tuple[str, float]]]:
        """Per run of equal characters the readings (letters, log probability).

        Look-alikes before the first and behind the last letter may also stand for themselves; in a spaced
        stretch a word may end behind every letter.
        """
        letters_at = [i for i, c in enumerate(stretch) if c.isalpha()] or [len(stretch)]
        for m in _EQUAL.finditer(stretch):
            c, n = m[1], len(m[0])
            letters = [(x, _SUBSTITUTED) for x in LOOKALIKES.get(c, "")] or [(c, 0.0)]
            column = [(x * k, cost * n + _REPEATED * (n - k)) for x, cost in letters for k in range(1, min(n, 2) + 1)]
            if spaced:
                column += [(f"{x} ", cost) for x, cost in column] + [
                    (f"{x} {x}{end}", cost * n + _REPEATED * (n - 2)) for x, cost in letters for end in ("", " ") if n > 1]
            elif c in LOOKALIKES and not letters_at[0] < m.start() < letters_at[-1]:
                column.append((m[0], 0.0))
            yield column

    def literal(self, text: str) -> float:
        """Log probability of a text as it stands."""
        total, x, y = 0.0, _BLANK, _BLANK
        for c in f"{text} ":
            z = self._class(c)
            total += float(self._model[x, y, z])
            x, y = y, z
        return total

    def viterbi(self, stretch: str, spaced: bool = False) -> tuple[float, str]:
        """Most probable clean reading of a stretch, with its log probability."""
        best: dict[tuple[int, int], tuple[float, str]] = {(_BLANK, _BLANK): (0.0, "")}
        settled: list[str] = []
        for i, column in enumerate(chain(self.lattice(stretch, spaced), [[(" ", 0.0)]])):
            then: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, read) in best.items():
                for letters, cost in column:
                    s, x, y = score + cost, a, b
                    for c in letters:
                        z = self._class(c)
                        s += float(self._model[x, y, z])
                        x, y = y, z
                    old = then.get((x, y))
                    if old is None or s > old[0]:
                        then[x, y] = (s, read + letters)
            best = then
            if i % _WINDOW == _WINDOW - 1:
                common = commonprefix([read for _, read in best.values()])
                settled.append(common)
                best = {k: (score, read[len(common):]) for k, (score, read) in best.items()}
        score, read = max(best.values())
        return score, ("".join(settled) + read).rstrip(" ")

    def _read(self, m: re.Match) -> str:
        stretch = m[0]
        read = self._known.get(stretch)
        if read is None:
            if len(self._known) >= _KEPT:
                self._known.clear()
            joined = re.sub(r"[ ._-]", "", stretch)
            spaced = len(joined) < len(stretch)
            score, read = self.viterbi(joined, spaced)
            if spaced and self.literal(stretch) > score + _SPACED_OUT:
                read = stretch                # single letters that make no likelier word stay apart
            if len(stretch) <= _CACHED:
                self._known[stretch] = read
        return read

    def _read_run(self, m: re.Match) -> str:
        runs = [len(x[0]) for x in _EQUAL.finditer(m[0])]
        # doubled letters are common in words, but seldom more than half of the letters
        return self._read(m) if max(runs) > 2 or 2 * sum(n > 1 for n in runs) > len(runs) else m[0]

    def restore(self, text: str | None) -> str:
        """Lower-cased text with hidden words replaced by their readings."""
        low = (text or "").lower()
        if not low:
            return ""
        low = _SPACED.sub(self._read, low)
        low = _HIDDEN.sub(self._read, low)
        return _LONG_RUN.sub(self._read_run, low) if _RUN.search(low) else low


_SEPARATED = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))


def line_of(restored: str) -> bytes:
    """Words of a restored text between blanks."""
    return b" " + restored.encode().translate(_SEPARATED) + b" "


def marks_of(restored: str) -> set[bytes]:
    """Beginnings (4 and 5 letters) and whole words, each with its blanks."""
    out = set()
    for w in set(line_of(restored).decode().split(" ")):
        if len(w) >= 3:
            out.add(f" {w} ".encode())
            for n in (4, 5):
                if len(w) > n:
                    out.add(f" {w[:n]}".encode())
    return out


@dataclass
class Scorer:
    """What scoring needs; small enough to travel with a task."""

    model: np.ndarray
    weights: dict[bytes, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _decoder: Decoder | None = field(default=None, repr=False)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_decoder": None, "_automaton": None}

    def evidence(self, text: str | None) -> tuple[float, float]:
        """(sum, largest) weight of the distinct marks in the restored text."""
        if self._decoder is None:
            self._decoder = Decoder(self.model)
            if self.weights:
                self._automaton = ahocorasick.Automaton()
                for mark, w in self.weights.items():
                    self._automaton.add_word(mark.decode("latin-1"), (mark, w))
                self._automaton.make_automaton()
        if self._automaton is None or not text:
            return 0.0, 0.0
        line = line_of(self._decoder.restore(text)).decode("latin-1")
        found = dict(x for _, x in self._automaton.iter(line))
        return sum(found.values()), max(found.values(), default=0.0)

    def score(self, text: str | None) -> float:
        total, top = self.evidence(text)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * total + c * top, -30, 30))))


def choose_marks(counts: DataFrame, toxic: int, clean: int, max_marks: int = MAX_MARKS) -> dict[bytes, float]:
    """Marks with strong evidence: log odds ratio of document counts, the strongest ``max_marks``."""
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    kept = counts.withColumn("w", odds).where((F.col("t") >= 4) & (F.col("w") > 2.5))
    rows = kept.orderBy(F.desc(F.col("t") * F.col("w")), "mark").limit(max_marks).select("mark", "w").collect()
    return {bytes(r["mark"]): r["w"] for r in rows}


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float, float]:
    """Logistic regression on (sum, largest) by Newton steps, with slopes held at zero or more."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    beta = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if not len(y) or y.min() == y.max():
        return tuple(beta)
    a = np.column_stack((np.ones(len(x)), x))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ a + ridge * np.eye(3)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        beta[1:] = np.maximum(beta[1:], 0)
    return tuple(float(b) for b in beta)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> Scorer:
    """Learn from ``documents`` (doc_id, text), all of them for letters, a bounded sample for labels."""
    counts = np.zeros(_CLASSES ** 3, np.int64)
    for r in count_trigrams(documents).collect():               # at most 64 ** 3 rows
        counts[r["key"]] = r["n"]
    scorer = Scorer(letter_model(counts), {})
    sample = common.materialise(common.labelled(documents, labels, label, max_rows).withColumn(
        "half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))), "toxicity-sample")
    model = scorer.model

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, seen = Decoder(model), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic == 1].update(marks_of(decoder.restore(text)))
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())],
            names=["mark", "t", "c"])

    first = sample.where("half = 0")
    n = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    counted = first.select("text", "label").mapInArrow(marks, "mark binary, t long, c long").groupBy("mark").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))
    scorer.weights = choose_marks(counted, n.get(1, 0), n.get(0, 0))

    @F.arrow_udf("total double, top double")
    def evidence(texts: pa.Array) -> pa.Array:
        got = np.array([scorer.evidence(t) for t in texts.to_pylist()], float).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["total", "top"])

    second = sample.where("half = 1").select("label", evidence.asNondeterministic()("text").alias("e"))
    got = second.select("label", "e.total", "e.top").toPandas().sort_values(["label", "total", "top"])
    curve = fit_curve(got[["total", "top"]].to_numpy(float), (got["label"].to_numpy() == 1).astype(float))
    return Scorer(scorer.model, scorer.weights, curve)


def scored(scorer: Scorer, text: Column | str) -> Column:
    """Score (0 to 1) of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t) for t in texts.to_pylist()], pa.float64())

    return score.asNondeterministic()(text)
