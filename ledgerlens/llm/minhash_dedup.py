"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so a signature of ``2 * PERMUTATIONS`` values needs only
``PERMUTATIONS`` hash evaluations per shingle.  A band takes its values from
different permutations, so a pair of sets with Jaccard similarity J shares a
band with probability J ** ROWS; with 48 bands of 5 values a pair at J = 0.75
shares none with probability 2e-6 (at J = 0.8, 1e-8).

Documents that share a band are candidates.  Links are confirmed by counting the
common shingles of the whole sets.  Candidates are worked off so that no group is
expanded into all its pairs:

1. Every bucket has a leader, and every document is held against the ``LEADERS`` of
   them that it meets in most of its buckets.  Confirmed links give components; a
   bucket within one component is done.
2. Members of one bucket that are then still in different components are compared:
   documents without a link one by one, others with all of a component's documents
   in hubs of ``HUB_DOCUMENTS``.

Before sets are compared, pairs are tested on lengths and on a sketch of the
signatures that rejects those whose similarity is surely too low.  A pair in one
bucket is then either confirmed, rejected, or already in one component, so
components are those of all links.

Equal sets are one class from the start; a class is represented by its smallest
doc_id.  Rows that share a doc_id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import textarrays as ta
from ledgerlens.llm.common import connected_components, materialize, maybe_in

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
BANDS = 48
ROWS = 5
PERMUTATIONS = BANDS * ROWS // 2
#: Leaders that a document is held against.
LEADERS = 6
#: Shingles of one verification group; larger groups are split.
GROUP_SHINGLES = 100_000
#: Documents of one component that are compared as one hub in the last step.
HUB_DOCUMENTS = 256
#: Set elements that are permuted at once.
_SLICE = 1 << 15

_rng = np.random.Generator(np.random.PCG64(77))
_FACTOR = _rng.integers(1, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_TERM = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_BAND_FACTOR = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def _band_values() -> tuple[np.ndarray, np.ndarray]:
    """For each band and row: the permutation, and whether its maximum is meant.

    Minima are dealt to bands in order and maxima one band further on, so that no
    band holds both values of a permutation.
    """
    low = np.arange(PERMUTATIONS)
    order = np.concatenate([low, np.roll(low, ROWS)]).reshape(BANDS, ROWS)
    is_max = np.concatenate([np.zeros(PERMUTATIONS, bool), np.ones(PERMUTATIONS, bool)]).reshape(BANDS, ROWS)
    return order, is_max


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima and maxima (2 x permutations x sets, unsigned 32 bit) of non-empty sets."""
    out = np.empty((2, PERMUTATIONS, len(bounds) - 1), np.uint32)
    at = 0
    while at < len(bounds) - 1:
        to = int(np.searchsorted(bounds, bounds[at] + _SLICE, side="right")) - 1
        to = min(max(to, at + 1), len(bounds) - 1)
        part = (values[bounds[at] : bounds[to]] >> np.uint64(32)).astype(np.uint32)
        starts = bounds[at:to] - bounds[at]
        y = np.empty_like(part)
        for k in range(PERMUTATIONS):
            np.bitwise_xor(part, _TERM[k], out=y)
            np.multiply(y, _FACTOR[k], out=y)
            out[0, k, at:to] = np.minimum.reduceat(y, starts)
            out[1, k, at:to] = np.maximum.reduceat(y, starts)
        at = to
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Band keys (sets x BANDS) as signed 64 bit."""
    order, is_max = _band_values()
    keys = np.zeros((BANDS, signature.shape[2]), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            value = signature[int(is_max[b, r]), order[b, r]].astype(np.uint64)
            keys[b] += ta.mix(value + _BAND_FACTOR[b, r]) * _BAND_FACTOR[b, r]
    return ta.mix(keys).T.copy().view(np.int64)


#: 64-bit words of a sketch, which holds four bits of each signature value.
SKETCH_WORDS = 2 * PERMUTATIONS // 16
#: Signature values in which sketches may differ.  At J = 0.75 one differs with
#: probability 15/64: 56 of 240 on average, standard deviation 6.6; 99 is six and a
#: half deviations away (probability 1e-10), and the average at J = 0.56.
SKETCH_MAX = 99


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each signature value, packed into signed 64-bit words (sets x SKETCH_WORDS)."""
    flat = signature.reshape(2 * PERMUTATIONS, -1)
    nibble = ta.mix(flat.astype(np.uint64)) & np.uint64(15)
    words = nibble.reshape(SKETCH_WORDS, 16, -1)
    packed = np.zeros((SKETCH_WORDS, words.shape[2]), np.uint64)
    for k in range(16):
        packed |= words[:, k] << np.uint64(4 * k)
    return packed.T.copy().view(np.int64)


def similar_enough(x: str, y: str) -> Column:
    """Can the sets of the aliased rows (n, sketch) reach the similarity?"""
    differing = F.lit(0)
    for k in range(SKETCH_WORDS):
        d = F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differing = differing + F.bit_count(d)
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (n * 100 >= m * SIMILARITY_PERCENT) & (m * 100 >= n * SIMILARITY_PERCENT) & (differing <= SKETCH_MAX)


_SIG = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for texts in ta.chunks(batch.column(1)):
            values, bounds = ta.shingle_sets(texts, SHINGLE_WORDS)
            n = np.diff(bounds)
            some = n > 0
            packed = np.zeros((len(texts), BANDS), np.int64)
            sketch = np.zeros((len(texts), SKETCH_WORDS), np.int64)
            sums = np.zeros((2, len(texts)), np.uint64)
            if some.any():
                starts = np.append(bounds[:-1][some], bounds[-1])
                signature = signatures(values, starts)
                packed[some], sketch[some] = bands(signature), sketches(signature)
                sums[0, some] = np.add.reduceat(ta.mix(values), starts[:-1])
                sums[1, some] = np.add.reduceat(ta.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(texts.first, len(texts)), pa.array(n.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel()), BANDS).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), SKETCH_WORDS).cast(pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"],
            )


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands, sketch) per row; (h1, h2) identify the set."""
    return docs.select("doc_id", "text").mapInArrow(_sign_batches, _SIG)


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, is_candidate, id, text) come sorted, a hub's members before its candidates."""
    hub, members = None, []
    for batch in batches:
        hubs, candidate, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        found_a, found_b = [], []
        for texts in ta.chunks(batch.column(3)):
            values, bounds = ta.shingle_sets(texts, SHINGLE_WORDS)
            for i in range(len(texts)):
                row = texts.first + i
                own = values[bounds[i] : bounds[i + 1]]
                if hubs[row] != hub:
                    hub, members = hubs[row], []
                if not candidate[row]:
                    members.append((ids[row], own.copy()))
                elif (link := next((m for m, other in members if _linked(own, other)), None)) is not None:
                    found_a.append(ids[row])
                    found_b.append(link)
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < SIMILARITY_PERCENT * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= SIMILARITY_PERCENT * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, members: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Links (a, b) of the documents a of ``pairs(a, n, hub)`` to a member b of the hub, by whole shingle sets.

    ``n``: shingles of a.  ``members(hub, id)``: a few documents each; None if every
    hub is a document.  One link per document and hub is returned.  A hub with many
    candidates is split into groups of about ``GROUP_SHINGLES`` shingles, each with
    its own copy of the members' texts; within a task rows stream by, and only the
    members' sets are kept.  Texts are shuffled of documents that are named only.
    """
    pairs = materialize(pairs)
    total = F.sum("n").over(Window.partitionBy("hub"))
    sized = pairs.select("a", "hub", F.ceil(total / GROUP_SHINGLES).cast("int").alias("groups"))
    candidates = sized.select(
        F.col("a").alias("id"), "hub", F.pmod(F.xxhash64("a"), "groups").cast("int").alias("part"), F.lit(1).alias("is_candidate"))
    hubs = sized.groupBy("hub").agg(F.max("groups").alias("groups"))
    hubs = hubs.withColumn("id", F.col("hub")) if members is None else hubs.join(members, "hub")
    part = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")
    rows = candidates.unionByName(hubs.select("id", "hub", part, F.lit(0).alias("is_candidate")))
    named = materialize(rows.select("id").distinct())
    texts = maybe_in(docs.select("doc_id", "text"), "doc_id", named).where("maybe")
    rows = rows.join(texts, F.col("id") == F.col("doc_id"))
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "is_candidate")
    return rows.select("hub", "is_candidate", "id", "text").mapInArrow(_confirm_batches, "a long, b long")


def _shared_buckets(reps: DataFrame) -> DataFrame:
    """(band, id) of the buckets with two members or more."""
    buckets = reps.select("id", F.explode("bands").alias("band")).distinct()
    many = buckets.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    return materialize(buckets.join(many, "band"))


def _placed(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(band, id, label): with the component of each member, its own id if it has no link yet."""
    return shared.join(label, shared["id"] == label["node"], "left").select("band", "id", F.coalesce("component", "id").alias("label"))


def _leader_pairs(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a: document, n: its shingles, hub: a leader) that can be similar enough.

    The leader of a bucket is its member with the smallest hash.
    """
    leaders = shared.groupBy("band").agg(F.min(F.struct(F.xxhash64("id"), "id")).alias("leader")).select("band", F.col("leader.id").alias("hub"))
    votes = shared.join(leaders, "band").where("id <> hub").groupBy(F.col("id").alias("a"), "hub").agg(F.count("*").alias("votes"))
    x, y = reps.select("id", "n", "sketch").alias("x"), reps.select("id", "n", "sketch").alias("y")
    near = votes.join(x, votes["a"] == F.col("x.id")).join(y, (votes["hub"] == F.col("y.id")) & similar_enough("x", "y"))
    best = Window.partitionBy("a").orderBy(F.desc("votes"), "hub")
    ranked = near.select("a", F.col("x.n").alias("n"), "hub", "votes").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= LEADERS).select("a", "n", "hub")


def _remaining(placed: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left to compare: pairs (a, b), pairs (a, hub), and the hubs' members (hub, id).

    First the documents are found that share a bucket with a similar enough partner
    of another component.  A component's documents are dealt to hubs of about
    ``HUB_DOCUMENTS``; a document of a smaller component that shares a bucket with
    any of them is held against the whole hub, so a component of m documents costs
    m / ``HUB_DOCUMENTS`` rows per document outside and not m.  Documents that are
    alone in their component are paired one by one.
    """
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rows = materialize(placed.join(mixed.select("band"), "band").join(reps.select("id", "n", "sketch"), "id"))
    x, y = rows.alias("x"), rows.alias("y")
    similar = (F.col("x.label") != F.col("y.label")) & similar_enough("x", "y")
    wanted = x.join(y, (F.col("x.band") == F.col("y.band")) & similar, "left_semi").select("id", "label").distinct()
    wanted = materialize(wanted)
    size = wanted.groupBy("label").agg(F.count("*").alias("size"))
    hub = F.xxhash64("label", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / HUB_DOCUMENTS)))
    rows = materialize(rows.join(wanted.join(size, "label").select("id", "size", hub.alias("hub")), "id"))

    x, hubs = rows.alias("x"), rows.where("size > 1").select("band", "hub", "label", "size").distinct().alias("h")
    smaller = (F.col("x.size") < F.col("h.size")) | ((F.col("x.size") == F.col("h.size")) & (F.col("x.label") > F.col("h.label")))
    to_hubs = x.join(hubs, (F.col("x.band") == F.col("h.band")) & (F.col("x.label") != F.col("h.label")) & smaller)
    to_hubs = to_hubs.select(F.col("x.id").alias("a"), F.col("x.n").alias("n"), F.col("h.hub").alias("hub")).distinct()
    alone = rows.where("size = 1").select("band", "id", "label", "n", "sketch")
    alone = materialize(alone.join(alone.groupBy("id").agg(F.collect_set("band").alias("bands")), "id"))
    x, y = alone.alias("x"), alone.alias("y")
    first = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")  # a pair is made in one bucket only
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") > F.col("y.id")) & similar & first)
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("x.n").alias("n"), F.col("y.id").alias("hub"))
    return pairs, to_hubs, rows.where("size > 1").select("hub", "id").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text, ...)``.

    Documents link when 100 * |A & B| >= 75 * |A | B| on their sets of distinct
    5-word shingles; component_id is the smallest doc_id reachable by links,
    kept is doc_id = component_id.

    Null text: as the empty text, with an empty set that links with nothing.
    Null doc_id: the row links with nothing, component_id null, kept true.
    Rows sharing a doc_id are one node; each row is returned.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(sign(docs))
    node = signed.where("doc_id is not null and n_shingles > 0")
    classes = materialize(node.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")))
    member = node.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["n_shingles", "h1", "h2"])
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = node.join(classes.select("n_shingles", "h1", "h2", F.col("rep").alias("doc_id")), ["n_shingles", "h1", "h2", "doc_id"])
    reps = materialize(reps.where("n_shingles > 1").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch"))
    shared = _shared_buckets(reps)
    links = materialize(confirm(_leader_pairs(shared, reps), None, docs))
    label = connected_components(links)
    pairs, to_hubs, members = _remaining(_placed(shared, label), reps)
    links = links.unionByName(confirm(pairs, None, docs)).unionByName(confirm(to_hubs, members, docs))

    final = connected_components(links.unionByName(same).distinct())
    out = signed.select("doc_id", "n_shingles").join(final, signed["doc_id"] == final["node"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
