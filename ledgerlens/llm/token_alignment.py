"""Alignment of two tokenizers' tokens over the same bytes, and how usual each token pair is in the corpus.

Both tokenizers cut space + text.  Where a token of A and one of B end at the
same byte, a group ends.  Those places are found by galloping intersection: of a
document's two lists of token ends, the shorter one drives, and each of its ends
is looked for in the longer one from a known lower bound on, by steps that double
until they pass it, and then by binary search inside the last step.  Ends of many
documents are searched side by side as arrays: first a few far apart, from their
document's beginning, then those between from where the last one landed, and so on
(``STRIDES``).  Ranks of common ends slice the tokens into groups, and differences of
ranks give each group's tokens of A and B, all of whose pairs are links.

A pair's count is in how many documents it is linked.  Documents are worked on in
chunks; a chunk asks for the counts of its distinct pairs, gets one answer row per
pair, and meets its documents again in a cogroup.  So counts are joined per chunk
and pair, not per document and pair, at every size alike, and nothing is
broadcast but one row per token id of A.

Null or empty text, and texts that either tokenizer does not give back byte by
byte: no tokens, zeros.  Null ids, repeated rows and rows sharing an id: one result
row each, each counted as a document.  Columns other than doc_id and text are
ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textarrays as ta
from ledgerlens.llm.common import materialize
from ledgerlens.llm.tokens import Encoder, pieces, ragged

#: Every 512th driving end is searched from its document's beginning, every 64th from the last of those, and so on.
STRIDES = (512, 64, 8, 1)
#: Bytes of texts of one chunk, about.
CHUNK_BYTES = 8 << 20
#: Links of one group that are made one by one; those of a larger group are made of its distinct ids.
GROUP_LINKS = 1024


class ByteTokens(Encoder):
    """Ids of a byte-level vocabulary, special strings read as text; ``pool[start[i]:start[i + 1]]`` are the bytes of id i."""

    def __init__(self, path: str):
        super().__init__(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab()
        printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        # a byte-level vocabulary writes the other bytes as the characters from 256 on
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printed))}
        self.pool, self.start = _pool({i: bytes(byte[c] for c in token) for token, i in vocabulary.items()})


class PieceTokens(Encoder):
    """Ids of a sentence-piece model that marks spaces and falls back to bytes; texts are given with the space before them.

    No piece holds a space behind another character, so no merge goes over the
    place before a single space, and pieces cut there are encoded on their own.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece of the model goes over a space")
        self.pool, self.start = _pool({
            i: bytes([int(name[3:5], 16)]) if self._model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)})
        self._forget()

    def _fill(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the model puts a space before what it is given
        made = self._model.encode([x[1:] for x in pieces], num_threads=1)
        lengths = np.array([len(x) for x in made], np.int64)
        return np.fromiter((i for x in made for i in x), np.uint32, int(lengths.sum())), lengths


def _pool(of_id: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    values = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in values])])


@functools.cache
def tokenizers(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteTokens(path_a), PieceTokens(path_b)


def gallop(wanted: np.ndarray, ends: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Index of the first of the ascending ``ends`` that is not below each wanted value; ``low``: indices not beyond it.

    ``ends`` must reach every wanted value.
    """
    at, step, live = low.copy(), np.ones(len(low), np.int64), np.arange(len(low))
    high = low.copy()
    while len(live):  # exponential: where ends[high] >= wanted, the answer is in [at, high]
        passed = ends[high[live]] >= wanted[live]
        live = live[~passed]
        at[live] = high[live] + 1
        high[live] = np.minimum(high[live] + step[live], len(ends) - 1)
        step[live] *= 2
    live = np.flatnonzero(at < high)
    while len(live):  # binary
        middle = (at[live] + high[live]) >> 1
        below = ends[middle] < wanted[live]
        at[live] = np.where(below, middle + 1, at[live])
        high[live] = np.where(below, high[live], middle)
        live = live[at[live] < high[live]]
    return at


def intersect(driver: np.ndarray, first: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each driving end the index of an equal one in ``ends``, or -1.

    ``first``: bounds of each document's part of ``driver``; ``begin``: where its part
    of ``ends`` begins.  Both lists ascend over all documents.
    """
    n = np.diff(first)
    rank = np.arange(len(driver)) - np.repeat(first[:-1], n)
    found = np.repeat(begin, n)
    for stride, wider in zip(STRIDES, (0, *STRIDES)):
        now = np.flatnonzero(rank % stride == 0 if not wider else (rank % stride == 0) & (rank % wider != 0))
        low = found[now] if not wider else found[now - rank[now] % wider]
        found[now] = gallop(driver[now], ends, low)
    return np.where(ends[found] == driver, found, -1) if len(driver) else found


def _ends(ids: np.ndarray, bounds: np.ndarray, tokens: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Running byte length after each token of all texts, and each text's byte length."""
    length = (tokens.start[1:] - tokens.start[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(length)])
    return total[1:], np.diff(total[bounds])


def _gives_back(ids: np.ndarray, bounds: np.ndarray, tokens: Encoder, texts: ta.Texts) -> np.ndarray:
    """Which texts are the joined bytes of their tokens."""
    _, length = _ends(ids, bounds, tokens)
    size = np.diff(texts.offsets)
    same = (length == size) & (size > 0)
    mine = np.repeat(same, np.diff(bounds))
    kept = ids[mine]
    joined = tokens.pool[ragged(tokens.start[kept], tokens.start[kept + 1] - tokens.start[kept])]
    given = texts.data[ragged(texts.offsets[:-1][same], size[same])]
    differs = np.concatenate([[0], np.cumsum(joined != given)])
    edges = np.concatenate([[0], np.cumsum(size[same])])
    same[np.flatnonzero(same)[np.diff(differs[edges]) > 0]] = False
    return same


def _only(ids: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds)
    return ids[np.repeat(keep, n)].astype(np.int64), np.concatenate([[0], np.cumsum(n * keep)])


class Aligned:
    """Tokens of A and B of some texts, and their groups.

    ``a[first_a[i]:first_a[i + 1]]`` are the tokens of text i; ``to_a`` and ``to_b``: how
    many tokens of all texts stand before the end of each group; ``groups``: bounds
    of each text's groups.
    """

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tokens: tuple[Encoder, Encoder]):
        (self.a, self.first_a), (self.b, self.first_b) = a, b
        end_a, _ = _ends(self.a, self.first_a, tokens[0])
        end_b, _ = _ends(self.b, self.first_b, tokens[1])
        shorter = np.diff(self.first_a) <= np.diff(self.first_b)
        common_a, common_b = [], []
        for mine, (end, first), (other, begin), out, back in (
                (shorter, (end_a, self.first_a), (end_b, self.first_b), common_a, common_b), (~shorter, (end_b, self.first_b), (end_a, self.first_a), common_b, common_a)):
            n = np.diff(first)
            chosen = np.flatnonzero(np.repeat(mine, n))
            found = intersect(end[chosen], np.concatenate([[0], np.cumsum(n[mine])]), other, begin[:-1][mine])
            out.append(chosen[found >= 0])
            back.append(found[found >= 0])
        self.to_a, self.to_b = np.sort(np.concatenate(common_a)) + 1, np.sort(np.concatenate(common_b)) + 1
        self.groups = np.searchsorted(self.to_a, self.first_a, side="right")
        self.groups[0] = 0
        self.size_a, self.size_b = np.diff(self.to_a, prepend=0), np.diff(self.to_b, prepend=0)

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of the distinct pairs of each text, ascending; pair = id of A * width + id of B."""
        n = self.size_a * self.size_b
        text_of = np.repeat(np.arange(len(self.groups) - 1), np.diff(self.groups))
        small = np.flatnonzero(n <= GROUP_LINKS)
        each = n[small]
        within = ragged(np.zeros(len(small), np.int64), each)
        wide = np.repeat(self.size_b[small], each)
        left = np.repeat((self.to_a - self.size_a)[small], each) + within // np.maximum(wide, 1)
        right = np.repeat((self.to_b - self.size_b)[small], each) + within % np.maximum(wide, 1)
        pair, text, times = [self.a[left] * width + self.b[right]], [np.repeat(text_of[small], each)], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(n > GROUP_LINKS):
            x, of_x = np.unique(self.a[self.to_a[g] - self.size_a[g] : self.to_a[g]], return_counts=True)
            y, of_y = np.unique(self.b[self.to_b[g] - self.size_b[g] : self.to_b[g]], return_counts=True)
            pair.append((x[:, None] * width + y).ravel())
            times.append((of_x[:, None] * of_y).ravel())
            text.append(np.full(len(x) * len(y), text_of[g]))
        return _summed(np.concatenate(text), np.concatenate(pair), np.concatenate(times))

    def written(self) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all texts one after the other, and the bounds of each text's part."""
        if not len(self.to_a):
            return b"", np.zeros(len(self.groups), np.int64)
        group_a = np.repeat(np.arange(len(self.to_a)), self.size_a)
        group_b = np.repeat(np.arange(len(self.to_b)), self.size_b)
        place_a = np.arange(len(group_a)) + (self.to_b - self.size_b)[group_a]
        place_b = np.arange(len(group_b)) + self.to_a[group_b]
        ids, mark = np.empty(len(group_a) + len(group_b), np.int64), np.full(len(group_a) + len(group_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a[: len(group_a)], self.b[: len(group_b)]
        mark[place_a[self.to_a - 1]], mark[place_b[self.to_b - 1]] = ord("|"), ord(";")
        pool, start = _digits()
        length = (start[1:] - start[:-1])[ids]
        ends = np.cumsum(length + 1)
        out = np.empty(ends[-1], np.uint8)
        out[ends - 1] = mark
        to = np.ones(ends[-1], bool)
        to[ends - 1] = False
        out[to] = pool[ragged(start[ids], length)]
        tokens_before = np.concatenate([[0], self.to_a + self.to_b])[self.groups]
        return out.tobytes(), np.concatenate([[0], ends])[tokens_before]


@functools.cache
def _digits() -> tuple[np.ndarray, np.ndarray]:
    return _pool({i: str(i).encode() for i in range(1 << 17)})


def _summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = int(pair.max(initial=0)) + 1
    key = text * width + pair
    if len(times) and times.max() > 1:  # of large groups
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
    else:
        key = np.sort(key)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.add.reduceat(times, at) if len(at) else times
    return key[at] // width, key[at] % width, times


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, all lowest bytes first: small numbers then shrink well in files and shuffles."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_ROW = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, documents array<int>"


def _empty_sha(written: bytes) -> str:
    return hashlib.sha256(written).hexdigest() if written else ""


def _rows(documents: list[tuple], chunk: int) -> pa.RecordBatch:
    """One row per document of a chunk; the first one also carries the chunk's distinct pairs and how many documents hold each."""
    every = [x[-2] for x in documents]
    pairs, held = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    columns = list(zip(*documents))
    # a document's pairs as places among the chunk's: steps between them are small numbers
    places = [_planes(np.diff(np.searchsorted(pairs, x), prepend=0)) for x in every]
    rest = [None] * (len(documents) - 1)
    arrays = [pa.array([chunk] * len(documents), pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string()),
              pa.array(places, pa.binary()), pa.array([_planes(x) for x in columns[7]], pa.binary()),
              pa.array([pairs, *rest], pa.list_(pa.int64())), pa.array([held.astype(np.int32), *rest], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "documents"])


def align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows ``_ROW`` per document: its groups and distinct links; chunks number their documents' pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        width = len(b.start) - 1
        chunk = TaskContext.get().partitionId() << 32
        documents, filled = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for texts in ta.chunks(batch.column(1)):
                cut_here = pieces(texts)
                (a_ids, a_bounds), (b_ids, b_bounds) = a.ids_of(texts, cut_here), b.ids_of(texts, cut_here)
                good = _gives_back(a_ids, a_bounds, a, texts) & _gives_back(b_ids, b_bounds, b, texts)
                found = Aligned(_only(a_ids, a_bounds, good), _only(b_ids, b_bounds, good), (a, b))
                text, pair, times = found.links(width)
                written, cut = found.written()
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                n_a, n_b, n_groups = np.diff(found.first_a), np.diff(found.first_b), np.diff(found.groups)
                total = np.concatenate([[0], np.cumsum(times)])
                for i in range(len(texts)):
                    lo, hi = edges[i], edges[i + 1]
                    # all but the last mark of a text, which ends its last group
                    sha = _empty_sha(written[cut[i] : max(cut[i + 1] - 1, cut[i])])
                    documents.append((ids[texts.first + i], n_a[i], n_b[i], n_groups[i], total[hi] - total[lo], sha, pair[lo:hi].copy(), times[lo:hi].copy()))
                filled += len(texts.data)
                if filled >= chunk_bytes:
                    yield _rows(documents, chunk)
                    chunk, documents, filled = chunk + 1, [], 0
        if documents:
            yield _rows(documents, chunk)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(" "), text))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), given.alias("text")).mapInArrow(work, _ROW)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): documents that hold each linked pair, and whether that is the highest count of its id of A."""
    held = aligned.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
    counts = materialize(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("count")))
    of_a = F.expr(f"pair div {width}")
    top = counts.groupBy(of_a.alias("id_a")).agg(F.max("count").alias("top"))  # one row per id of A's vocabulary at most
    return counts.join(F.broadcast(top), of_a == F.col("id_a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def correspondences(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(id_a, id_b, count, best): the corpus's table of linked ids."""
    width = _width(path_b)
    scored = pair_counts(materialize(align(docs, path_a, path_b)), width)
    return scored.select(F.expr(f"cast(pair div {width} as int)").alias("id_a"), F.expr(f"cast(pair % {width} as int)").alias("id_b"), "count", "best")


def _width(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs(doc_id, text, ...)``.

    n_best: links whose pair's count is the highest of its id of A; count_sum: counts over links.
    """
    aligned = materialize(align(docs, path_a, path_b, chunk_bytes))
    scored = pair_counts(aligned, _width(path_b))
    asked = aligned.select(F.col("chunk").alias("asking"), F.explode("pairs").alias("pair"))
    answers = asked.join(scored, "pair").select("asking", "pair", "count", "best")

    def meet(documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("pair")
        count, best = answers["count"].to_numpy(), answers["best"].to_numpy().astype(bool)
        sums, bests = [], []
        for places, times in zip(documents["places"], documents["times"]):
            at, times = np.cumsum(_from_planes(places), dtype=np.int64), _from_planes(times).astype(np.int64)
            sums.append(int((count[at] * times).sum()))
            bests.append(int(times[best[at]].sum()))
        return documents.drop(columns=["chunk", "places", "times"]).assign(n_best=bests, count_sum=sums)

    # ids travel as text: pandas turns a column of whole numbers with a null among them into floats
    mine = aligned.drop("pairs", "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = mine.groupBy("chunk").cogroup(answers.groupBy("asking")).applyInPandas(meet, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
