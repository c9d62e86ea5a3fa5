"""Best-fit packing of token sequences by sum of squares.

Documents are encoded, closed with an end id, and cut into pieces of at most
``capacity`` ids where they are longer.  Pieces are dealt to shards of about
``PIECES_PER_SHARD`` by a hash, and each shard is packed from long to short:
N(g) open sequences have a gap of g, and a piece goes where the sum of N(g) ** 2
becomes smallest, which keeps gaps of every width at hand.  Ties go to the
smallest gap that fits.  A task keeps the gaps of one shard, which are bounded by
its pieces; a shard's waste is a few sequences, so the whole waste is that of
one shard times the number of shards, a fixed small share.

Null text: as the empty text, one piece that holds the end id alone.  Null ids,
repeated rows and rows sharing an id are separate documents.  Columns other than
doc_id and text are ignored, whatever their names.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import tokens
from ledgerlens.llm.common import materialize

CAPACITY = 1024
END_ID = 2
PIECES_PER_SHARD = 65_536


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit integers.

    All pieces but a document's first have ``capacity`` ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            for first, ids, bounds in encoder.encode(batch.column(1)):
                n_texts = len(bounds) - 1
                closed = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(n_texts + 1)
                n = np.diff(bounds)
                count = -(-n // capacity)
                row = np.repeat(np.arange(n_texts), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = (n - capacity * (count - 1))[row]
                start = np.where(piece == 0, 0, head + capacity * (piece - 1))
                length = np.where(piece == 0, head, capacity)
                edges = np.append(4 * (bounds[row] + start), 4 * len(closed)).astype(np.int64)
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(closed)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n_texts).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                     pa.array(length.astype(np.int64)), values.cast(pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


class Gaps:
    """Open sequences of one shard by their gap."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1)  # at 0 and capacity: full and new ones, which don't count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece; the sequence is new if that makes the sum of squares least."""
        c, n = self.capacity, self.count
        if length == c:
            self.made += 1
            return self.made - 1, 0
        after = 2 * n[: c - length + 1] + 1  # what one more sequence with the gap that is left adds
        after[0] = 0
        change = after - (2 * n[length:] - 1)  # and what the one with the old gap takes away
        change[-1] = after[-1]
        change[:-1][n[length:c] == 0] = math.inf
        gap = length + int(np.argmin(change))
        if gap == c:
            sequence = self.made
            self.made += 1
        else:
            sequence = self.open[gap].pop()
            n[gap] -= 1
        if gap > length:
            self.open[gap - length].append(sequence)
            n[gap - length] += 1
        return sequence, c - gap


def pack(rows: DataFrame, capacity: int = CAPACITY, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """``rows(length, ...)`` with sequence_id and offset; other columns go along.

    ``rows`` is read twice (once to count), so give a table or a written frame.
    Its columns must not be named shard, sequence_id or offset.
    """
    shards = max(1, math.ceil(rows.count() / pieces_per_shard))
    keys = [c for c, kind in rows.dtypes if kind != "binary"]
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), *keys)
    schema = T.StructType([*dealt.drop("shard").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gaps = None, None
        for batch in batches:
            lengths, shard = batch.column("length").to_pylist(), batch.column("shard").to_pylist()
            sequence, offset = [], []
            for n, s in zip(lengths, shard):
                if s != current:
                    current, gaps = s, Gaps(capacity)
                at, where = gaps.place(n)
                sequence.append((s << 32) + at)
                offset.append(where)
            own = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return dealt.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from packed rows that carry ids: the ids of at most ``capacity`` tokens in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def packed_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    cut = pieces(docs, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(cut))
