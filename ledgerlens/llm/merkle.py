"""Merkle manifest of a dataset: roots per language, one root, and a proof for every document.

A document's leaf is the sha256 of its five columns; the leaves of a language
stand in order of doc_id, and every run of ``FANOUT`` nodes becomes one node of
the next level until one is left, the language's subroot.  Subroots, in order of
the language, give the root in the same way.

Positions come from a sort over ranges: each task numbers its rows, and the rows
that earlier tasks hold of the same language are added from a table with one row
per task and language.  A tree is worked on in superblocks of ``FANOUT **
BLOCK_LEVELS`` neighbouring nodes.  Upwards, each superblock is reduced to one
node, and those nodes are the next tier.  Downwards, the nodes of a superblock
are cogrouped with its outer nodes: the siblings on its way from its top to the
root, one row, which the tier above has worked out for it.  That one call
finishes the reduction inside the block, joins inner and outer siblings to each
node's proof and folds the (perhaps changed) leaf up to a root.  Texts are
hashed where they are read and are never shuffled; a group holds one superblock,
whatever the size of its language.

Null columns are hashed as ``-``; a null lang is a tree of its own, the first one.
A null doc_id stands first in its tree and is never tampered with.  Rows sharing a
doc_id stand in order of their leaves; equal rows have equal leaves and take
neighbouring places, any way round.  Columns besides the five are ignored,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize

FANOUT = 8
#: Levels that one superblock spans: it holds up to 8 ** 4 = 4,096 nodes.
BLOCK_LEVELS = 4
#: One document in so many is tampered with to test the proofs.
TAMPER_EVERY = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _field(column: Column) -> Column:
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(column).cast("string"), F.lit(":"), column))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered) per row; tree: one string per lang, in the order of langs; tampered: null if the row is left as it is."""
    doc_id, lang, text = F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    head = [_field(c) for c in (doc_id.cast("string"), F.col("source").cast("string"), lang, F.col("n_chars").cast("long").cast("string"))]
    touched = (F.crc32(doc_id.cast("string")) % TAMPER_EVERY == 0) & text.isNotNull()
    return docs.select(
        F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang)).alias("tree"), doc_id.alias("doc_id"),
        F.sha2(F.concat(*head, _field(text)), 256).alias("leaf"),
        F.when(touched, F.sha2(F.concat(*head, _field(F.translate(text, _UPPER, _LOWER))), 256)).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with pos, the place in its tree by ``order``, and size, the rows of its tree.

    The table of counts has one row per task and tree at most.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("task", F.shiftright("at", 33)))
    counts = ranged.groupBy("tree", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select(
        "tree", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")))
    return ranged.join(counts, ["tree", "task"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def height(size: int) -> int:
    """Levels above the nodes of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FANOUT**BLOCK_LEVELS}"))


def _levels(row: pd.Series) -> int:
    return min(BLOCK_LEVELS, height(int(row["size"])))


def _reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level of a block, lowest first."""
    out = [digests]
    for _ in range(levels):
        low = out[-1]
        out.append([digest("".join(low[i : i + FANOUT])) for i in range(0, len(low), FANOUT)])
    return out


def _siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node in its run, level by level."""
    left, right = [], []
    for nodes in levels[:-1]:
        start = at - at % FANOUT
        left.append("".join(nodes[start:at]))
        right.append("".join(nodes[at + 1 : start + FANOUT]))
        at //= FANOUT
    return left, right


def _tier_above(nodes: DataFrame) -> DataFrame:
    """(tree, pos, size, digest): one node per superblock."""

    def top(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        levels = _levels(first)
        nodes = _reduced(block.sort_values("pos")["digest"].tolist(), levels)[-1]
        return pd.DataFrame({"tree": [first["tree"]], "pos": [first["block"]], "size": [-(-int(first["size"]) // FANOUT**levels)], "digest": nodes})

    blocks = _in_blocks(nodes.select("tree", "pos", "size", "digest"))
    return blocks.groupBy("tree", "block").applyInPandas(top, "tree string, pos long, size long, digest string")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tiers above, up to one node per tree."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    out = [nodes]
    for _ in range(-(-height(largest) // BLOCK_LEVELS)):
        out.append(materialize(_tier_above(out[-1])))
    return out


_OUTER = "lefts array<string>, rights array<string>, subroot string, root string"


def _paths(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(tree, pos, digest, lefts, rights, subroot, root) of each node, from its superblock and the block's outer nodes."""

    def join(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, above = block.sort_values("pos"), above.iloc[0]
        levels = _reduced(block["digest"].tolist(), _levels(block.iloc[0]))
        paths = [_siblings(levels, i) for i in range(len(block))]
        return pd.DataFrame({
            "tree": block["tree"].tolist(), "pos": block["pos"].tolist(), "digest": levels[0], "lefts": [p[0] + list(above["lefts"]) for p in paths],
            "rights": [p[1] + list(above["rights"]) for p in paths], "subroot": above["subroot"], "root": above["root"]})

    blocks = _in_blocks(nodes.select("tree", "pos", "size", "digest")).groupBy("tree", "block")
    return blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(join, f"tree string, pos long, digest string, {_OUTER}")


def _outer_of(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """(tree, block, lefts, rights, subroot, root) of the lowest tier's superblocks, from the tops' rows."""
    outer = top
    for tier in reversed(tiers[1:]):
        outer = materialize(_paths(tier, outer).drop("digest").withColumnRenamed("pos", "block"))
    return outer


def _written_leaves(docs: DataFrame) -> DataFrame:
    return materialize(leaves(docs)).withColumnRenamed("leaf", "digest")


def trees(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Tiers of the languages' trees, tiers of the tree of subroots, and the latter's lowest tier with its names."""
    own = _tiers(numbered(_written_leaves(docs), ["doc_id", "digest"]))
    subroots = own[-1].select(F.lit("root").alias("tree"), F.col("tree").alias("name"), "digest")
    named = materialize(numbered(subroots, ["name"]))
    return own, _tiers(named.select("tree", "pos", "size", "digest")), named


def manifest(docs: DataFrame) -> DataFrame:
    """(lang, documents, subroot, root) per language: what a holder of the dataset publishes."""
    own, above, named = trees(docs)
    sizes = own[0].groupBy("tree").agg(F.count("*").alias("documents"))
    root = above[-1].select(F.col("tree").alias("of"), F.col("digest").alias("root"))
    out = named.join(sizes.withColumnRenamed("tree", "name"), "name").join(root, F.col("tree") == F.col("of"))
    lang = F.when(F.col("name") == "", F.lit(None)).otherwise(F.expr("substring(name, 2)"))
    return out.select(lang.alias("lang"), "documents", F.col("digest").alias("subroot"), "root")


def _fold(start: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        start = digest(left + start + right)
    return start


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs(doc_id, source, lang, n_chars, text)``.

    proof_sha256: digest of the siblings on the way to the root.  folded_root: the
    root that the row's proof gives after a row in ``TAMPER_EVERY`` had its text
    lower-cased (A-Z); verified: it is the root.
    """
    own, above, named = trees(docs)
    empty = F.array().cast("array<string>")
    top = above[-1].select("tree", F.lit(0).cast("long").alias("block"), empty.alias("lefts"), empty.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    of_names = _outer_of(above, top)
    places = _paths(above[0], of_names).drop("tree").join(named.select("pos", "name"), "pos")
    tops = materialize(places.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "lefts", "rights", F.col("digest").alias("subroot"), "root"))
    outer = _outer_of(own, tops)

    def prove(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, above = block.sort_values("pos"), above.iloc[0]
        levels = _reduced(block["digest"].tolist(), _levels(block.iloc[0]))
        outer_left, outer_right = list(above["lefts"]), list(above["rights"])
        proof, folded = [], []
        for i, (leaf, tampered) in enumerate(zip(levels[0], block["tampered"].tolist())):
            left, right = _siblings(levels, i)
            left, right = left + outer_left, right + outer_right
            proof.append(digest("".join(x + y for x, y in zip(left, right))))
            folded.append(_fold(tampered if isinstance(tampered, str) else leaf, left, right))
        return pd.DataFrame({
            "doc_id": block["doc_id"], "leaf": levels[0], "subroot": above["subroot"], "root": above["root"], "proof_sha256": proof, "folded_root": folded,
            "verified": [x == above["root"] for x in folded]})

    # ids travel as text: pandas turns a column of whole numbers with a null among them into floats
    blocks = _in_blocks(own[0].withColumn("doc_id", F.col("doc_id").cast("string"))).groupBy("tree", "block")
    out = blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(
        prove, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
