"""Licence scan: Aho-Corasick finds tags and phrases, a shunting-yard parser reads licence expressions.

A text is reduced to its words joined by single blanks; one automaton finds all phrases at word
boundaries in one pass. Where it finds an identifier tag, the expression behind the tag in the text
itself is parsed with operators WITH, AND, OR (strongest first) and brackets, and evaluated to the sets
of licences that satisfy it; its licences join the labels. The readable start ends at the first token that
does not continue it. An expression with too many sets has all its labels, and shows itself instead of its sets.

Defined results: a null, empty or wordless text has no words, no places, null first and last word, empty
labels and score 0. A tag without a readable expression adds no label. Repeated documents are scanned
each. The score is 0 without evidence, else 1 - 2^-e for e pieces of evidence, an expression that reads
in full counting two.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, functions as F

# fixed values: phrases of the base scan and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# notices and tags of the method's own
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier",)
_TAG = re.compile(r"spdx-license-identifier\s*:\s*([^\n*<>\"']+)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_IN_WORD = re.compile(r"\w")       # a name that goes on with other letters is none
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_BLANKED = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256)).lower()
MAX_ALTERNATIVES = 4096         # sets shown; labels and score do not depend on it
_MAX_STEPS = 1 << 22


class TooMany(ValueError):
    """More sets than are shown."""


def postfix(expression: str) -> list[str]:
    """Shunting-yard: names and operators in evaluation order; ValueError if it does not read in full."""
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, False
    expression = expression.rstrip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"unreadable at {at}")
        token, at = m[1], m.end()
        low = token.lower()
        if token == "(":
            if operand:
                raise ValueError("bracket after a name")
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                raise ValueError("bracket without partner")
            stack.pop()
        elif low in _STRENGTH:
            if not operand:
                raise ValueError("operator without name")
            while stack and _STRENGTH.get(stack[-1], 0) >= _STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        else:
            if operand:
                raise ValueError("two names without operator")
            out.append(low)
            operand = True
    if not operand:
        raise ValueError("no name at the end")
    while stack:
        if stack[-1] == "(":
            raise ValueError("open bracket")
        out.append(stack.pop())
    return out


def alternatives(expression: str) -> list[frozenset[str]]:
    """Sets of licences each of which satisfies the expression; ``a with b`` is one licence."""
    stack: list[list[frozenset[str]]] = []
    steps = 0
    for token in postfix(expression):
        if token not in _STRENGTH:
            stack.append([frozenset([token])])
            continue
        b, a = stack.pop(), stack.pop()
        if token != "with":
            several = len(a) * len(b) if token == "and" else len(a) + len(b)
            steps += several * (len(a[-1]) + len(b[-1]) if token == "and" else 1)
            if several > MAX_ALTERNATIVES or steps > _MAX_STEPS:
                raise TooMany("too many alternatives")
        if token == "or":
            stack.append(list(dict.fromkeys(a + b)))
        elif token == "and":
            stack.append(list(dict.fromkeys(x | y for x in a for y in b)))
        else:
            if len(a) != 1 or len(a[0]) != 1 or len(b) != 1 or len(b[0]) != 1:
                raise ValueError("with needs two names")
            stack.append([frozenset([f"{next(iter(a[0]))} with {next(iter(b[0]))}"])])
    return stack[0]


def licences_of(expression: str) -> set[str]:
    """Names of an expression, without the exceptions behind ``with``."""
    stack: list[str | None] = []
    names: Counter[str] = Counter()
    for token in postfix(expression):
        if token not in _STRENGTH:
            stack.append(token)
            names[token] += 1
            continue
        b = stack.pop()
        if token == "with":
            names[b] -= 1
        else:
            stack[-1] = None
    return {x for x, n in names.items() if n > 0}


def readable_end(found: str) -> int:
    """Where the longest readable start of what follows a tag ends, 0 if there is none; one walk over the tokens."""
    # per open bracket: whether it holds AND or OR, the operator before, whether the operand just read is one name
    levels: list[list] = [[False, None, None]]
    at = end = 0
    while m := _TOKEN.match(found, at):
        token, at = m[1].lower(), m.end()
        level = levels[-1]
        if token == "(":
            if level[2] is not None:
                break
            levels.append([False, None, None])
            continue
        if token in _STRENGTH:
            if level[2] is None or token == "with" and not level[2]:
                break
            levels[-1] = [level[0] or token != "with", token, None]
            continue
        single = True
        if token == ")":
            if len(levels) == 1 or level[2] is None:
                break
            single = level[2] and not level[0]
            levels.pop()
            level = levels[-1]
        elif level[2] is not None or _IN_WORD.match(found, at):
            break
        if level[1] == "with" and not single:
            break
        level[2] = single
        if len(levels) == 1:
            end = at
    return end


def readable_start(found: str) -> list[frozenset[str]]:
    """Alternatives of the longest readable start of what follows a tag; empty if there is none."""
    end = readable_end(found)
    return alternatives(found[:end]) if end else []


class Scanner:
    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None):
        base, notices = BASE if base is None else base, NOTICES if notices is None else notices
        kinds: dict[str, tuple] = {t: ("tag", "") for t in TAGS}
        kinds |= {p: ("notice", label) for p, label in notices.items()}
        kinds |= {p: ("base", label) for p, label in base.items()}
        self._automaton = ahocorasick.Automaton()
        for phrase, (kind, label) in kinds.items():
            self._automaton.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
        self._automaton.make_automaton()

    def _places(self, line: str) -> Iterator[tuple[str, str, int]]:
        """(kind, label, first word); the count of words before goes on from the last place."""
        at = seen = 0
        for end, (kind, label, size) in self._automaton.iter(line):
            begin = end + 1 - size
            if begin >= at:
                seen += line.count(" ", at, begin)
                at = begin
                word = seen
            else:                       # a longer phrase that began before the one just seen
                word = seen - line.count(" ", begin, at)
            yield kind, label, word

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, alternatives, score."""
        words = (text or "").encode().translate(_BLANKED).split()
        if not words:
            return 0, 0, None, None, "", "", "", 0.0
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts, base, labels, evidence, tagged = [], set(), set(), 0, False
        for kind, label, word in self._places(line):
            if kind == "tag":
                tagged = True
                continue
            evidence += 1
            labels.add(label)
            if kind == "base":
                base.add(label)
                starts.append(word)
        wholes = []
        if tagged:
            for m in _TAG.finditer(text):
                read = m[1][:readable_end(m[1])]
                if not read:
                    continue
                labels |= licences_of(read)
                evidence += 2
                try:
                    wholes.append(" or ".join(sorted("+".join(sorted(s)) for s in alternatives(read))))
                except TooMany:
                    wholes.append(f"more than {MAX_ALTERNATIVES} sets of {' '.join(read.lower().split())}")
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), "; ".join(w for w in wholes if w), 1.0 - 0.5 ** min(evidence, 50))


_FIELDS = (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"),
           ("labels", "string"), ("alternatives", "string"), ("score", "double"))
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def scanned(text: Column | str) -> Column:
    """Struct of the scan's results for a text column."""

    @F.arrow_udf(", ".join(f"{n} {t}" for n, t in _FIELDS))
    def scan(texts: pa.Array) -> pa.Array:
        scanner = Scanner()
        got = list(zip(*[scanner.scan(t) for t in texts.to_pylist()])) or [()] * len(_FIELDS)
        return pa.StructArray.from_arrays([pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(got, _FIELDS)],
                                          names=[n for n, _ in _FIELDS])

    return scan.asNondeterministic()(text)
