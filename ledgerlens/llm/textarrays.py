"""Words of a batch of texts as numpy arrays, without a Python loop over words.

Texts stay UTF-8 bytes: ASCII bytes never occur inside a longer code point, so
white space, lower-casing of A-Z and line breaks can be read byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of texts that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Texts:
    """``data``: the bytes of all texts; text i is ``data[offsets[i]:offsets[i + 1]]``; it is row ``first + i``."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column (null: empty) in pieces of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


@dataclass
class Words:
    """Words of all texts in order: byte bounds, 64-bit hash, and ``first[i]:first[i + 1]`` those of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of True that stay within one text."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return start, np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, from one running polynomial sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power(_BASE, len(data)), out=total[1:])
    value = (total[end] - total[start]) * power(_INVERSE, len(data) + 1)[start]
    return mix(value + (end - start).astype(np.uint64))


def words(texts: Texts, lower: bool = False) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    start, end = spans(~SPACE[data], texts.offsets)
    return Words(start, end, hash_spans(data, start, end), np.searchsorted(start, texts.offsets))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``size`` words within one text."""
    starts = np.arange(len(w.hash))
    last = np.repeat(w.first[1:], w.count)
    starts = starts[starts + size <= last]
    total = np.zeros(len(starts), np.uint64)
    for k in range(size):
        total += mix(w.hash[starts + k] + _PLACE[k]) * _PLACE[k]
    return starts, mix(total)


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the bounds of each text's part.

    A shingle is ``size`` words in lower case (A-Z); a text with fewer words has
    its whole sequence as one shingle, and one without words has none.
    """
    w = words(texts, lower=True)
    starts, hashes = windows(w, size)
    count = w.count
    made = np.maximum(count - size + 1, 0)
    short = np.flatnonzero((count > 0) & (count < size))
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(made + ((count > 0) & (count < size)), out=bounds[1:])
    values = np.empty(bounds[-1], np.uint64)
    is_short = np.zeros(len(values), bool)
    is_short[bounds[short]] = True
    values[~is_short] = hashes
    for i in short:
        part = w.hash[w.first[i] : w.first[i + 1]]
        values[bounds[i]] = mix(np.array([(mix(part + _PLACE[: len(part)]) * _PLACE[8 : 8 + len(part)]).sum() + np.uint64(len(part))], np.uint64))[0]
    for i in np.flatnonzero(made > 1):
        values[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][bounds[:-1] < len(values)]] = True
    kept = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return values[keep], kept[bounds]
