"""Spelling variants: words one edit apart, found by dynamic programming over sorted word lists.

Two words one edit apart agree in the first half of the shorter one or in the rest of it. So every word joins
the lists of the words with its own or one more code point that share its first half, and of those that share
its second half (read backwards). A list is walked once per word in sorted order: the rows of the banded edit
matrix up to the common prefix of neighbours (LCP) are kept, and where a prefix already exceeds one edit the
whole range of words with that prefix is skipped.

A list of more than ``LIST_WORDS`` words is dealt again by half of what its words may still differ in, down to
one code point, where the alphabet bounds it (90 words, and 8,100 one code point longer). Which list finds a
pair follows from where it differs, so every pair is found once, and no pair is left out.

Defined results: null and empty texts have no words; a null id counts as an empty id text; repeated rows count
each time; a vocabulary without words gives an empty result. Words of any length are handled.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aeroframe.llm import common

LEAST_LENGTH, LEAST_COUNT = 7, 2
DELETE_EVERY = 31
TIMES = 10                       # how much more frequent a form must be
LIST_WORDS = 500                 # a longer list is dealt again
_TABLE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def count_words(documents: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all words of (doc_id, text) with enough code points; tasks add up before the shuffle."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")          # a longer match never starts inside a run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall((text or "").encode().translate(_TABLE).decode())).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % DELETE_EVERY == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1:]
                        if len(word) < least_length:
                            continue
                    seen[word] += n
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    return documents.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _lists(words: DataFrame) -> DataFrame:
    """(short, front, back, key, word, n): each word in its two lists as the shorter and as the longer one of a pair.

    A list holds words of ``short`` and ``short`` + 1 code points that share ``front`` first and ``back`` last ones.
    """
    length = F.char_length("word")
    both = F.explode(F.array(length, length - 1)).alias("short")
    half = F.expr("short div 2")
    lists = F.explode(F.array(F.struct(half.alias("front"), F.lit(0).alias("back")), F.struct(F.lit(0).alias("front"), (F.col("short") - half).alias("back")))).alias("l")
    return words.select("word", "n", both).where("short > 0").select("word", "n", "short", lists).select("word", "n", "short", "l.front", "l.back")


def _keyed(lists: DataFrame) -> DataFrame:
    ends = F.concat(F.substr("word", F.lit(1), F.col("front")), F.lit("\n"), F.when(F.col("back") > 0, F.right("word", F.col("back"))).otherwise(""))
    return lists.withColumn("key", F.concat_ws("\n", "short", "front", "back", ends))


def _dealt_again(lists: DataFrame) -> DataFrame:
    """The words of too large lists, by half of what may still differ."""
    left = F.col("short") - F.col("front") - F.col("back")
    half = F.greatest(F.lit(1), F.expr("(short - front - back) div 2"))
    nearer = F.explode(F.array(F.struct((F.col("front") + half).alias("f"), F.col("back").alias("b")),
                               F.struct(F.col("front").alias("f"), (F.col("back") + left - half).alias("b")))).alias("l")
    return lists.select("word", "n", "short", nearer).select("word", "n", "short", F.col("l.f").alias("front"), F.col("l.b").alias("back"))


def _bounded_lists(words: DataFrame, list_words: int) -> DataFrame:
    """(word, n, short, front, back, key) with at most ``list_words`` words in a list (an action per round)."""
    now, done = _keyed(_lists(words)), []
    while True:
        large = now.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.first("short").alias("s"), F.first("front").alias("f"), F.first("back").alias("b"))
        # with one code point left there is nothing to halve, and no more words than code points allow
        large = common.materialise(large.where((F.col("k") > list_words) & (F.col("s") - F.col("f") - F.col("b") > 1)).select("key"), "large-lists")
        if large.isEmpty():
            break
        done.append(now.join(large, "key", "left_anti"))
        now = common.materialise(_keyed(_dealt_again(now.join(large, "key", "left_semi"))), "lists")
    for more in done:
        now = now.unionByName(more)
    return now


class SortedList:
    """Distinct words of one list in sorted order."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lcp = [0]
        for a, b in zip(words, words[1:]):
            k, most = 0, min(len(a), len(b))
            while k < most and a[k] == b[k]:
                k += 1
            self.lcp.append(k)

    def after(self, prefix: str, at: int) -> int:
        """First place behind the words with ``prefix``, which the word at ``at`` has."""
        words, lcp, depth = self.words, self.lcp, len(prefix)
        for j in range(at + 1, min(at + 9, len(words))):
            if lcp[j] < depth:
                return j
        return bisect_left(words, prefix + "\U0010ffff", at)

    def near(self, i: int) -> Iterator[int]:
        """Places behind ``i`` of the words exactly one edit from word ``i``.

        A row holds three cells of the edit matrix about the diagonal, all counts above one alike.
        """
        words, lcp = self.words, self.lcp
        q = words[i]
        size = len(q)
        rows = [(1, 0, 1)] * (size + 1)            # of the word against itself
        rows[0] = (2, 0, 1)
        known = size
        j, total = i + 1, len(words)
        while j < total:
            w = words[j]
            d = min(lcp[j], known)
            lo, on, up = rows[d]
            dead = False
            for c in w[d:]:
                # cells of the next row: q[:d], q[:d + 1], q[:d + 2] against w[:d + 1]
                x = lo if 0 < d <= size and q[d - 1] == c else lo + 1
                lo = min(x, on + 1)
                y = on if d < size and q[d] == c else on + 1
                z = up if d + 1 < size and q[d + 1] == c else up + 1
                on = min(y, up + 1, lo + 1)
                up = min(z, on + 1) if d + 2 <= size else 2
                if d >= size:
                    on = 2 if d + 1 > size else on
                d += 1
                if lo > 1 and on > 1 and up > 1:
                    dead = True
                    break
                if d < len(rows):
                    rows[d] = (lo, on, up)
                else:
                    rows.append((lo, on, up))
                known = d
            if dead:
                following = self.after(w[:d], j)
                known = min(known, d - 1)
            else:
                known = d
                off = size - len(w)
                if -1 <= off <= 1 and (lo, on, up)[off + 1] == 1:
                    yield j
                following = j + 1
            if following < total and following > j + 1:
                # what the next word shares with the one before it holds for all that was skipped
                known = min(known, lcp[following])
            j = following


def _pairs(lists: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every near pair once in each direction."""

    def found(short: int, front: int, back: int, held: dict[str, int]) -> Iterator[tuple[str, str]]:
        turned = front < back                      # read backwards where more of the end is shared
        ordered = SortedList(sorted(w[::-1] for w in held) if turned else sorted(held))
        for i in range(len(ordered.words)):
            for j in ordered.near(i):
                a, b = ordered.words[i], ordered.words[j]
                if turned:
                    a, b = a[::-1], b[::-1]
                if min(len(a), len(b)) == short and first_list(a, b, short, front, back):
                    yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []
        key, shape, held = None, (0, 0, 0), {}

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], [], []]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                              names=["word", "n", "near", "near_n"])
            out.clear()
            return made

        def close() -> None:
            if len(held) > 1:
                for a, b in found(*shape, held):
                    out.append((a, held[a], b, held[b]))
                    out.append((b, held[b], a, held[a]))

        for batch in batches:
            for k, w, n, *s in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    close()
                    key, shape, held = k, s, {}
                held[w] = n
            if len(out) > 50_000:
                yield batch_of()
        close()
        yield batch_of()

    dealt = lists.select("key", "word", "n", "short", "front", "back").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def first_list(a: str, b: str, short: int, front: int, back: int) -> bool:
    """Whether the list that shares ``front`` first and ``back`` last code points is the one that reports the pair.

    Halving goes the way the pair agrees, to the front where it can.
    """
    f = k = 0
    while (f, k) != (front, back):
        left = short - f - k
        half = left // 2 if f + k == 0 else max(1, left // 2)
        if left <= 1:
            return False
        if a[f:f + half] == b[f:f + half]:
            f += half
        else:
            k += left - half
        if f > front or k > back:
            return False
    return True


def variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (doc_id, text)."""
    words = common.materialise(count_words(documents, least_length).where(F.col("n") >= least_count), "vocabulary")
    pairs = _pairs(_bounded_lists(words, list_words))
    best = F.min(F.when(F.col("near_n") >= times * F.col("n"), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = common.materialise(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n")), "near-words")

    # a form is at least ``times`` as frequent, so chains are short and have no loops; each round doubles the reach
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 0
    hops, reach = 1, 1
    while times ** hops <= most:
        hops += 1
    while reach < hops:
        onward = links.select(F.col("root").alias("onward"), F.col("word").alias("root"))
        links = common.materialise(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
        reach *= 2
    known = words.join(near, "word", "left").join(links, "word", "left")
    return known.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
