"""Near-duplicate vectors by an epsilon grid order join.

Vectors of length one with cosine >= c are at most eps = sqrt(2 - 2c) apart, and
a projection onto orthonormal axes brings no two points further apart.  So
vectors are projected onto their leading principal axes, laid into grid cells of
width eps, and sorted by cell; the sorted sequence is cut into blocks, which are
written once.  Two blocks are joined unless their bounding boxes are more than
eps apart, and the join of two blocks halves both sequences recursively, again
skipping halves that are provably too far apart, down to leaves that are compared
by one matrix product.  That product is in single precision and picks, with its
error bound, the pairs that are then compared in double precision.  Axes only
steer the skipping: they are fitted on ``AXES_SAMPLE`` vectors, and results do
not depend on them.

The pairs of blocks are a Cartesian product whose tasks read the written blocks,
so no block is shuffled: what is on disk follows the vectors, and only the work
may grow with their square.

Equal vectors are one class from the start.  A pair of blocks returns, for each
class, how many vectors it links to and one root of its local component, so a
dense group yields rows in proportion to its members and not to its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import connected_components, materialize

COSINE = 0.95
#: Vectors that the axes are fitted on; leading axes used; most vectors of a block and of a leaf.
AXES_SAMPLE, AXES, BLOCK, LEAF = 4096, 12, 8192, 256
#: Most bytes of the vectors of a block, and of the blocks that a task of the product holds of one side.
BLOCK_BYTES, SIDE_BYTES = 1 << 21, 1 << 25


def _axes(classes: DataFrame, width: int) -> np.ndarray:
    """Leading principal axes (width x AXES) of a fixed-size sample, chosen by a hash of the id."""
    rows = classes.select("vector").orderBy(F.xxhash64("rep"), "rep").limit(AXES_SAMPLE).toArrow().column(0).combine_chunks()
    x = _unit(_padded(rows, width))
    if len(x) < 2:
        return np.eye(width, min(AXES, width))
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=True)
    return np.ascontiguousarray(vt[: min(AXES, width)].T)


def _padded(rows: pa.ListArray, width: int) -> np.ndarray:
    """A matrix of the lists, which have ``width`` numbers at most; shorter ones are followed by zeros."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(rows) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(rows), width), flat.dtype)
    out[np.arange(width) < pc.list_value_length(rows).to_numpy(zero_copy_only=False)[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _blocks(classes: DataFrame, axes: np.ndarray, width: int, eps: float, stored: str) -> DataFrame:
    """Blocks of the grid-ordered sequence: bounds on each axis, ids, copies and vectors."""
    size = min(BLOCK, max(64, BLOCK_BYTES // (width * np.dtype(stored).itemsize)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column(2), width).astype(stored)
            p = _unit(x) @ axes / eps if len(x) else np.zeros((0, axes.shape[1]))
            cells = np.floor(p)
            # 16 bits of each cell, then the place within the cell on the first axis: bytes that sort as the numbers do
            key = np.column_stack([np.clip(cells, -(1 << 15), (1 << 15) - 1) + (1 << 15), (p[:, :1] - cells[:, :1]) * ((1 << 16) - 1)]).astype(">u2")
            binary = (_bytes(key), _bytes(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *binary], names=["rep", "copies", "cells", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= size:
                yield block((task << 32) + made, held[:size])
                held, made = held[size:], made + 1
        if held:
            yield block((task << 32) + made, held)

    def block(number: int, rows: list) -> pa.RecordBatch:
        rep, copies, vector = zip(*rows)
        data = [np.array(rep, "<i8").tobytes(), np.array(copies, "<i8").tobytes(), b"".join(vector)]
        place = _unit(np.frombuffer(data[2], stored).reshape(len(rows), -1)) @ axes
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([place.min(0).tolist()]), pa.array([place.max(0).tolist()]), *(pa.array([x], pa.binary()) for x in data)],
            names=["block", "low", "high", "reps", "copies", "vectors"])

    ordered = classes.mapInArrow(project, "rep long, copies long, cells binary, vector binary")
    ordered = ordered.repartitionByRange("cells", "rep").sortWithinPartitions("cells", "rep").drop("cells")
    return materialize(ordered.mapInArrow(cut, "block long, low array<double>, high array<double>, reps binary, copies binary, vectors binary"))


def _bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) with the ids, copies and vectors of both, for each pair of blocks, and each with itself, whose boxes come within eps.

    A task reads the blocks of two parts of the files.  Of a pair, either block may be ``a``, by their hashes, so that
    tasks have alike shares.
    """
    spark = blocks.sparkSession
    total = blocks.agg(F.sum(F.length("reps") + F.length("copies") + F.length("vectors"))).first()[0] or 0
    parts = max(math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)), -(-total // SIDE_BYTES))
    sides = [blocks.coalesce(parts).select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "ab"]
    gap = F.zip_with(
        F.zip_with("low_a", "high_b", lambda a, b: a - b), F.zip_with("low_b", "high_a", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    even = F.xxhash64("block_a").bitwiseXOR(F.xxhash64("block_b")).bitwiseAND(F.lit(1).cast("long")) == 0
    once = (F.col("block_a") == F.col("block_b")) | ((F.col("block_a") != F.col("block_b")) & ((F.col("block_a") < F.col("block_b")) == even))
    # any other join would send the blocks themselves
    pairs = sides[0].hint("shuffle_replicate_nl").join(sides[1], once & (apart <= eps * eps * (1 + 1e-9)))
    return pairs.select(*(f"{c}_{side}" for side in "ab" for c in ("block", "reps", "copies", "vectors")))


class _Block:
    def __init__(self, reps: bytes, copies: bytes, vectors: bytes, axes: np.ndarray, stored: str):
        self.rep, self.copies = np.frombuffer(reps, "<i8"), np.frombuffer(copies, "<i8")
        self.raw = np.frombuffer(vectors, stored).reshape(len(self.rep), -1)
        self.unit = _unit(self.raw)
        self.single, self.place, self.boxes = self.unit.astype(np.float32), self.unit @ axes, {}

    def box(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        if (s.start, s.stop) not in self.boxes:
            self.boxes[s.start, s.stop] = self.place[s].min(0), self.place[s].max(0)
        return self.boxes[s.start, s.stop]


def _join_sequences(x: _Block, y: _Block, a: slice, b: slice, least: float, eps: float) -> Iterator[tuple[slice, slice, np.ndarray | tuple]]:
    """Joins two intervals of grid-ordered sequences; of a block with itself, each pair once.

    Yields two leaves and what links them: a matrix where many may, else the places (i, j) of the links.
    """
    same = x is y
    (low_a, high_a), (low_b, high_b) = x.box(a), y.box(b)
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    if (gap * gap).sum() > eps * eps * (1 + 1e-9):
        return
    n, m = a.stop - a.start, b.stop - b.start
    if n > LEAF or m > LEAF:
        halves = lambda s: [slice(s.start, h := (s.start + s.stop) // 2), slice(h, s.stop)] if s.stop - s.start > LEAF else [s]
        for i in halves(a):
            for j in halves(b):
                if not same or i.start <= j.start:
                    yield from _join_sequences(x, y, i, j, least, eps)
        return
    # a product of single precision is off by less than this bound, whatever the order of its sums
    maybe = x.single[a] @ y.single[b].T >= np.float32(least - (x.unit.shape[1] + 8) * 2.0**-23)
    if same and a == b:
        maybe = np.triu(maybe, 1)
    at = np.flatnonzero(maybe)
    if len(at) > 4 * (n + m):
        cos = x.unit[a] @ y.unit[b].T
        for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):
            cos[i, j] = _cosine(x.raw[a.start + i], y.raw[b.start + j])
        linked = (cos >= least) & maybe
        if linked.any():
            yield a, b, linked
    elif len(at):
        i, j = np.divmod(at, m)
        cos = np.einsum("ij,ij->i", x.unit[a][i], y.unit[b][j])
        for k in np.flatnonzero(np.abs(cos - least) < 1e-12):
            cos[k] = _cosine(x.raw[a.start + i[k]], y.raw[b.start + j[k]])
        if (cos >= least).any():
            yield a, b, (i[cos >= least], j[cos >= least])


def _cosine(u: np.ndarray, v: np.ndarray) -> float:
    u, v = u.astype(np.float64), v.astype(np.float64)
    return u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v))


def _spanning(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A few links that connect what ``linked`` connects: at most one for each row and column."""
    label = np.where(linked.any(1), np.arange(len(linked)), len(linked))
    while True:
        column = np.where(linked, label[:, None], len(linked)).min(0)
        row = np.minimum(label, np.where(linked, column[None, :], len(linked)).min(1))
        if (row == label).all():
            break
        label = row
    for i in np.flatnonzero((label < np.arange(len(linked)))):
        yield ("row", int(i)), ("row", int(label[i]))
    for j in np.flatnonzero(column < len(linked)):
        yield ("column", int(j)), ("row", int(column[j]))


def _link_pair(x: _Block, y: _Block, least: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, linked vectors, root) of the classes of two blocks that have links between them."""
    same = x is y
    reps = x.rep if same else np.concatenate([x.rep, y.rep])
    shift, links, parent = 0 if same else len(x.rep), np.zeros(len(reps), np.int64), list(range(len(reps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(i: int, j: int) -> None:
        u, v = root(i), root(j)
        if u != v:
            low, high = (u, v) if reps[u] < reps[v] else (v, u)
            parent[high] = low

    for a, b, linked in _join_sequences(x, y, slice(0, len(x.rep)), slice(0, len(y.rep)), least, eps):
        if isinstance(linked, tuple):
            i, j = linked[0] + a.start, linked[1] + b.start
            np.add.at(links, i, y.copies[j])
            np.add.at(links, j + shift, x.copies[i])
            for u, v in zip(i.tolist(), (j + shift).tolist()):
                unite(u, v)
            continue
        links[a] += linked @ y.copies[b]
        links[b.start + shift : b.stop + shift] += x.copies[a] @ linked
        place = {"row": a.start, "column": b.start + shift}
        for (s, i), (t, j) in _spanning(linked):
            unite(place[s] + i, place[t] + j)

    some = np.flatnonzero(links)
    return reps[some], links[some], reps[[root(int(i)) for i in some]] if len(some) else reps[:0]


def _links(pairs: DataFrame, axes: np.ndarray, least: float, eps: float, stored: str) -> DataFrame:
    """(rep, links, root) of each pair of blocks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = None, None
        for batch in batches:
            for i in range(len(batch)):
                a, *data = (batch.column(c)[i].as_py() for c in range(4))
                if a != number:  # a block meets all its partners of a task in turn
                    number, own = a, _Block(*data, axes, stored)
                b, *data = (batch.column(c)[i].as_py() for c in range(4, 8))
                rep, links, root = _link_pair(own, own if a == b else _Block(*data, axes, stored), least, eps)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(root)], names=["rep", "links", "root"])

    return pairs.mapInArrow(join, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, ...)``.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; so do rows without a vec_id, whose component_id is null and kept
    true.  A shorter vector counts as followed by zeros.  Repeated rows are
    vectors of their own that link with each other.  Other columns are ignored,
    whatever their names.  An empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(~bad & some, F.lit(False))
    rows = rows.select("vec_id", "vector", usable.alias("usable"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))
    good = rows.where("usable")
    classes = materialize(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    out = rows.join(classes.drop("vector"), ["h1", "h2"], "left")
    if width is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    eps = math.sqrt(2 - 2 * cosine)
    stored = "<f4" if kind == "array<float>" else "<f8"
    axes = _axes(classes, width)
    blocks = _blocks(classes.select("rep", "copies", "vector"), axes, width, eps, stored)
    found = materialize(_links(_block_pairs(blocks, eps), axes, cosine, eps, stored))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "linked")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    out = out.join(links, out["rep"] == links["linked"], "left").join(component, out["rep"] == component["node"], "left")
    n_links = F.when(F.col("usable"), F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).otherwise(F.lit(0).cast("long"))
    component_id = F.when(F.col("usable"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", n_links.alias("n_links"), component_id.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
