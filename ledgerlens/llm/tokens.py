"""Token ids of a public byte-level vocabulary file, with remembered words.

A byte-level vocabulary splits a text before a single space that stands between
two characters that are not white space, whatever else stands around it, so the
pieces cut there are encoded on their own.  Pieces are found and hashed as
arrays; the ids of each distinct piece are remembered, so only new pieces go
through the tokenizer, and a text's ids are put together by table look-up.
Pieces are told apart by a 64-bit hash; among the ``REMEMBERED`` pieces that a
worker holds, two share one with probability under 1e-7.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ledgerlens.llm import textarrays as ta

#: Pieces that a worker remembers at once; beyond, it starts anew.
REMEMBERED = 600_000
#: Bytes of texts encoded together; characters of one string of new pieces.
TOGETHER_BYTES, JOINED = 1 << 20, 4000

# First bytes of UTF-8 characters among which no Unicode white space is, and ASCII without it
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0xC3:] = True
_PLAIN[[0xE1, 0xE2, 0xE3]] = False


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the pieces of all texts; empty texts have none."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[_PLAIN[data[at + 1]]]
    lead = at - 1
    for _ in range(3):  # back to the first byte of the character before
        lead = lead - ((data[lead] & 0xC0) == 0x80) * (lead > 0)
    at = at[_PLAIN[data[lead]]]
    # a space that ends or begins a text is not between two of its characters
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    return np.sort(np.concatenate([at, offsets[:-1][np.diff(offsets) > 0]]))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


@dataclass
class Pieces:
    """Bounds of the pieces of some texts; ``hashes``: the distinct ones, first met at ``first``; piece i is number ``back[i]`` of them."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    back: np.ndarray


def pieces(texts: ta.Texts) -> Pieces:
    start = piece_starts(texts.data, texts.offsets)
    end = np.append(start[1:], len(texts.data)) if len(start) else start
    return Pieces(start, end, *np.unique(ta.hash_spans(texts.data, start, end), return_index=True, return_inverse=True))


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        # one character of a byte-level token stands for one byte
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self._bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self._hash, self._at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._length, self._pool, self._filled = np.zeros(0, np.int64), np.zeros(1 << 20, np.uint32), 0

    def _ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _fill(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each has.

        Pieces that can stand in a row are encoded as one string and told apart by their bytes.
        """
        lengths = np.zeros(len(pieces), np.int64)
        strings, members, row, size = [], [], [], 0
        for i, x in enumerate(pieces):
            if x[0] == " " and len(x) > 1 and not x[1].isspace() and not x[-1].isspace():
                row.append(i)
                size += len(x)
                if size > JOINED:
                    strings.append("".join([pieces[k] for k in row]))
                    members.append(row)
                    row, size = [], 0
            else:
                strings.append(x)
                members.append([i])
        if row:
            strings.append("".join([pieces[k] for k in row]))
            members.append(row)
        made = self._ids(strings)
        order = np.concatenate([np.array(m) for m in members])
        for m, ids in zip(members, made):
            if len(m) == 1:
                lengths[m[0]] = len(ids)
            else:
                ends = np.cumsum([len(pieces[k].encode()) for k in m])
                lengths[m] = np.diff(np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1, prepend=0)
        flat = np.concatenate(made)
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        return flat[ragged(start, lengths)], lengths

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, lengths = self._fill(pieces)
        if self._filled + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros(max(len(ids), len(self._pool)), np.uint32)])
        self._pool[self._filled : self._filled + len(ids)] = ids
        start = self._filled + np.cumsum(lengths) - lengths
        self._filled += len(ids)
        where = np.searchsorted(self._hash, hashes)
        self._hash, self._at = np.insert(self._hash, where, hashes), np.insert(self._at, where, start)
        self._length = np.insert(self._length, where, lengths)

    def ids_of(self, texts: ta.Texts, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, and bounds of each text's ids."""
        hashes, start, end = pieces.hashes, pieces.start, pieces.end
        if len(self._hash) > REMEMBERED:
            self._forget()
        where = np.searchsorted(self._hash, hashes)
        known = np.zeros(len(hashes), bool)
        inside = where < len(self._hash)
        known[inside] = self._hash[where[inside]] == hashes[inside]
        if not known.all():
            raw, new = texts.data.tobytes(), pieces.first[~known]
            self._learn(hashes[~known], [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())])
            where = np.searchsorted(self._hash, hashes)
        at, length = self._at[where][pieces.back], self._length[where][pieces.back]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return self._pool[ragged(at, length)], total[np.searchsorted(start, texts.offsets)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row of the first text, ids of some texts, bounds of each text's ids); a null text is empty."""
        for texts in ta.chunks(column, TOGETHER_BYTES):
            yield texts.first, *self.ids_of(texts, pieces(texts))


@functools.cache
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
