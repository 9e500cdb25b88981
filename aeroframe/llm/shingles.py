"""Word shingles of whole Arrow batches, hashed on the UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_POSITIONS = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(random value by place in the word and lower-cased byte, whether a byte is a blank)."""
    rng = np.random.default_rng(20240607)
    values = rng.integers(1, 2 ** 64, (_POSITIONS, 256), dtype=np.uint64)
    values[:, 65:91] = values[:, 97:123]                   # A-Z count as a-z
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    values[:, blank] = 0
    return values, blank


def mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _chunks(data: np.ndarray, edges: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about a mebibyte that end at a text's end or a blank."""
    at = 0
    while at < len(data):
        end = at + _CHUNK
        if end >= len(data):
            end = len(data)
        else:
            k = np.searchsorted(edges, end, "right") - 1
            if edges[k] > at:
                end = int(edges[k])                        # whole texts
            else:                                          # one long text: go on to the next blank
                stop = int(edges[k + 1])
                while end < stop and not blank[data[end]]:
                    end += 1
        yield at, end
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every lower-cased word, first word of every text plus the total)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    values, blank = _tables()
    hashes, places = [], []
    for a, b in _chunks(raw, edges, blank):
        part = raw[a:b]
        inside = ~blank[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begun = edges[np.searchsorted(edges, a):np.searchsorted(edges, b)] - a
        first[begun] = inside[begun]                       # a text's first byte begins a word
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        place = np.arange(b - a) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [b - a]))))
        v = values[place & (_POSITIONS - 1), part]
        if place.max() >= _POSITIONS:
            v = v * (2 * (place // _POSITIONS) + 1).astype(np.uint64)
        hashes.append(mixed(np.add.reduceat(v, starts)))
        places.append(starts + a)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return words, np.searchsorted(at, edges)


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of ``size`` words per text; a shorter text is one shingle, a wordless one none."""
    words, first = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = mixed(rolled + words[k:n - size + 1 + k] + np.uint64(k + 1)) if len(rolled) else rolled
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(rolled[a:b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mixed(whole + words[k:k + 1] + np.uint64(1000 + k - a))
            yield whole
        else:
            yield words[:0]


def count_common(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted sets held as bytes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    z = np.sort(np.concatenate((x, y)))
    return int((z[1:] == z[:-1]).sum())
