"""Cost-balanced packing of token ids into sequences of a fixed capacity.

A document's ids are cut into full sequences; what is left over is packed: in descending order every
remainder goes to the sequence with the lowest cost, linear plus quadratic in the length of its pieces,
that has room. A group opens half a percent more sequences than its tokens fill; a remainder that fits
nowhere whole is cut over those with room. Groups are consecutive documents of one
input partition and hold a bounded number of tokens, so nothing is shuffled and no token list travels.

Defined results: a null or empty text is the end token alone; repeated documents are packed each on
their own; an empty table gives no pieces; sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
END = 1
GROUP_TOKENS = 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_SLACK = 0.005
# fixed value: the vocabulary's published way to cut a text into pieces, with possessive repeats
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


# fixed value: the vocabulary's added tokens, found in a text before it is cut into pieces
ADDED = {"<|endoftext|>": 50256}


class Ids:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes; an added token quoted in a text is its one id."""

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._of = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self._added = re.compile("(" + "|".join(map(re.escape, ADDED)) + ")")

    def of(self, text: str) -> bytes:
        ids = []
        for part in self._added.split(text):          # each part is cut as a text of its own
            ids += [ADDED[part]] if part in ADDED else self._of.encode_ordinary(part)
        return np.array(ids, "<u4").tobytes()


class _Room:
    """Open sequences by free tokens; finds the cheapest with at least so many free."""

    def __init__(self, n: int, capacity: int):
        self._size = 1 << capacity.bit_length()
        self._best: list[tuple[float, int] | None] = [None] * (2 * self._size)
        self._heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self._heaps[capacity] = [(0.0, s) for s in range(n)]
        self._refresh(capacity)

    def _refresh(self, free: int) -> None:
        heap, i, best = self._heaps[free], free + self._size, self._best
        best[i] = heap[0] if heap else None
        i >>= 1
        while i:
            a, b = best[2 * i], best[2 * i + 1]
            now = a if b is None or a is not None and a <= b else b
            if best[i] == now:
                break
            best[i] = now
            i >>= 1

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, free) of the cheapest with ``least`` free tokens or more."""
        best, i, found = self._best, least + self._size, None
        j = 2 * self._size
        while i < j:                          # the nodes that cover [least, end)
            if i & 1:
                if best[i] is not None and (found is None or best[i] < best[found]):
                    found = i
                i += 1
            i >>= 1
            j >>= 1
        if found is None:
            return None
        while found < self._size:
            found = 2 * found if best[2 * found] == best[found] else 2 * found + 1
        free = found - self._size
        cost, s = heapq.heappop(self._heaps[free])
        self._refresh(free)
        return cost, s, free

    def put(self, cost: float, sequence: int, free: int) -> None:
        if free:
            heapq.heappush(self._heaps[free], (cost, sequence))
            self._refresh(free)


def sequences(tokens: int, capacity: int = CAPACITY) -> int:
    """How many sequences a group opens."""
    least = -(-tokens // capacity)
    return least + int(least * _SLACK)


def balance(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR,
            quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in it, length, sequence, offset) of items no longer than the capacity."""
    room = _Room(sequences(sum(lengths), capacity), capacity)
    pieces = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        start, left = 0, lengths[k]
        while left:
            got = room.take(left)
            if got is None:                   # fits nowhere whole: fill the cheapest with any room
                got = room.take(1)
            cost, s, free = got
            n = min(left, free)
            pieces.append((k, start, n, s, capacity - free))
            room.put(cost + linear * n + quadratic * n * n, s, free - n)
            start, left = start + n, left - n
    return pieces


def pack(documents: DataFrame, ranks_path: str, capacity: int = CAPACITY, end: int = END,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece (SCHEMA); ``documents`` needs doc_id and text."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Ids(ranks_path)
        next_sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rest: list[tuple[int | None, int, int, bytes]] = []       # doc_id, ids before, ids of the document, ids
        held = 0

        def close() -> None:
            nonlocal next_sequence, held
            for k, start, n, s, offset in balance([len(r[3]) // 4 for r in rest], capacity):
                doc_id, before, total, raw = rest[k]
                rows.append((doc_id, before + start, n, zlib.crc32(raw[4 * start:4 * (start + n)]), total,
                             next_sequence + s, offset))
            next_sequence += sequences(held, capacity)
            rest.clear()
            held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=[c.split()[0] for c in SCHEMA.split(", ")])
                rows.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = tokenizer.of(text or "") + last
                total = len(raw) // 4
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    crc = zlib.crc32(raw[4 * start:4 * (start + capacity)])
                    rows.append((doc_id, start, capacity, crc, total, next_sequence, 0))
                    next_sequence += 1
                if total > full:
                    rest.append((doc_id, full, total, raw[4 * full:]))
                    held += total - full
                if held >= group_tokens:
                    close()
            yield from flush()
        close()
        yield from flush()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
