"""De-duplicated exposure of duplicate payments.

The duplicate findings name pairs, so k copies of one payment count
k * (k - 1) / 2 times in their total.  Here the pairs are united into clusters of
payments; the largest payment of a cluster is taken as the one that was due, and
the others are exposed, each once with its own amount.

Clusters are found by contraction: every node points to its smallest neighbour,
pointers are followed by doubling, and edges are redrawn between the roots until
none is left.  A node's neighbours are never gathered (minima are combined
map-side), and every step is written to the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, written

EXPOSURE_MONEY = "decimal(38,2)"


def connected(edges: DataFrame) -> DataFrame:
    """(node, cluster) of every node of ``edges(a, b)``; a cluster is named by its smallest node."""
    checkpoint_dir(edges.sparkSession)
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    label = None
    while not live.isEmpty():
        lowest = live.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(live.select(F.col("a").alias("node"), F.col("a").alias("to")))
        pointer = lowest.groupBy("node").agg(F.min("to").alias("to")).checkpoint()
        while True:   # to is never larger than node, so pointers end at roots
            nxt = pointer.select(F.col("node").alias("via"), F.col("to").alias("beyond"))
            longer = pointer.join(nxt, pointer["to"] == nxt["via"]).select("node", "to", "beyond")
            if longer.where("beyond <> to").isEmpty():
                break
            pointer = longer.select("node", F.col("beyond").alias("to")).checkpoint()
        if label is None:
            label = pointer.withColumnRenamed("to", "cluster")
        else:
            moved = label.join(pointer.withColumnRenamed("node", "at"), F.col("cluster") == F.col("at"), "left")
            label = moved.select("node", F.coalesce("to", "cluster").alias("cluster")).checkpoint()
        x, y = pointer.select(F.col("node").alias("a"), F.col("to").alias("ra")), pointer.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        redrawn = live.join(x, "a").join(y, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        live = redrawn.distinct().checkpoint()
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("cluster")).where("false")
    return label


def payment_clusters(pairs: DataFrame) -> DataFrame:
    """(row_id, cluster, amount, exposed) of every payment in ``pairs(row_id_1, amount_1, row_id_2, amount_2, ...)``.

    ``exposed`` is false for the largest payment of a cluster (of equal ones, the
    one with the smallest row id).
    """
    of = connected(pairs.select(F.col("row_id_1").alias("a"), F.col("row_id_2").alias("b")))
    paid = (pairs.select(F.col("row_id_1").alias("row_id"), F.col("amount_1").alias("amount"))
            .unionByName(pairs.select(F.col("row_id_2").alias("row_id"), F.col("amount_2").alias("amount"))).distinct())
    rows = of.join(paid, of["node"] == paid["row_id"]).select("row_id", "cluster", "amount")
    due = rows.groupBy("cluster").agg(F.min_by("row_id", F.struct(F.negative("amount"), "row_id")).alias("due"))
    return rows.join(due, "cluster").select("row_id", "cluster", "amount", (F.col("row_id") != F.col("due")).alias("exposed"))


def cluster_exposure(duplicates: DataFrame) -> DataFrame:
    """(cluster, payments, total, largest, exposure) of every cluster of duplicate payments."""
    rows = payment_clusters(written(duplicates.select("row_id_1", "row_id_2", "amount_1", "amount_2")))
    return rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount").cast(EXPOSURE_MONEY).alias("total"), F.max("amount").alias("largest"),
        F.coalesce(F.sum(F.when(F.col("exposed"), F.col("amount"))), F.lit(0)).cast(EXPOSURE_MONEY).alias("exposure"))


def with_exposure(duplicates: DataFrame) -> DataFrame:
    """The findings with ``exposure``: their sum counts each exposed payment once.

    An exposed payment is put on its first finding, by row ids; a finding has the
    sum of what is put on it, else 0.
    """
    duplicates = written(duplicates)
    exposed = payment_clusters(duplicates).where("exposed").select("row_id", "amount")
    place = F.struct(F.col("row_id_1").alias("r1"), F.col("row_id_2").alias("r2"))
    named = duplicates.select(F.col("row_id_1").alias("row_id"), place.alias("f")).unionByName(
        duplicates.select(F.col("row_id_2").alias("row_id"), place.alias("f")))
    first = named.groupBy("row_id").agg(F.min("f").alias("f")).join(exposed, "row_id")
    put = first.groupBy(F.col("f.r1").alias("r1"), F.col("f.r2").alias("r2")).agg(F.sum("amount").cast(EXPOSURE_MONEY).alias("exposure"))
    joined = duplicates.join(put, (F.col("row_id_1") == F.col("r1")) & (F.col("row_id_2") == F.col("r2")), "left").drop("r1", "r2")
    return joined.withColumn("exposure", F.coalesce("exposure", F.lit(0)).cast(EXPOSURE_MONEY))
