"""Shared helpers: reading a table, cutting lineage, and connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def is_local(spark: SparkSession) -> bool:
    """Are driver and executors one process?"""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """On a local master, give the workers this package, which the driver may have from a folder not on their path.

    A cluster's executors get it the usual way (installed, or as ``--py-files``).
    """
    context = spark.sparkContext
    if context.applicationId in _shipped or not is_local(spark):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ledgerlens-")) / "ledgerlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder; its tasks can import this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerlens-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local master, where driver and executors are one process, gets a temporary
    folder if the setting is unset; any other master without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage beyond those files, so an executor lost later costs
    a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Least and most bits of a bitmap of keys: 16 MB at most.
BITMAP_BITS = (1 << 20, 1 << 27)
_PART = 32_768  # bits of one row of a bitmap, 4 KB


def bitmap(keys: DataFrame) -> tuple[int, DataFrame]:
    """The number of bits, and rows (part, bits) in which bit ``key`` modulo that number is set for each row of ``keys(key)``.

    16 bits a key within ``BITMAP_BITS``, so that the rows have 16 MB at most, whatever the number of keys.
    """
    bits, wanted = BITMAP_BITS[0], 16 * keys.count()
    while bits < min(wanted, BITMAP_BITS[1]):
        bits *= 2
    at = keys.select((F.pmod("key", F.lit(bits)) + 1).alias("at"))
    parts = at.groupBy((F.bitmap_bucket_number("at") - 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return bits, parts


def maybe_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``maybe``: true for all rows whose ``key`` is in ``ids(id)`` and for a few others.

    Only a bitmap of the hashed ids is sent to the rows, which are not shuffled.
    What is true can then be joined exactly.
    """
    bits, parts = bitmap(ids.select(F.xxhash64("id").alias("key")))
    parts = F.broadcast(materialize(parts).withColumnRenamed("part", "__part").withColumnRenamed("bits", "__bits"))
    out = rows.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(bits)))
    out = out.join(parts, F.expr(f"__at div {_PART}") == F.col("__part"), "left")
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast((__at % {_PART}) div 8 as int) + 1, 1)), 16, 10) as int)")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0
    return out.withColumn("maybe", F.coalesce(is_set, F.lit(False))).drop("__at", "__part", "__bits")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``, as ``(node, component)``.

    Large-star and small-star rounds over the edge table; every round is written
    to the shared folder.  A node's neighbours are never gathered: each round
    takes a minimum per node (combined map-side) and joins it back, so a hub with
    many neighbours is split by the skew join.  Nodes without edges are absent.
    """
    current = materialize(_larger_first(edges))
    state = _fingerprint(current)
    while state[0]:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = _larger_first(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b")))
        current = materialize(_larger_first(small))
        before, state = state, _fingerprint(current)
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed), F.sum(F.col("b").cast("decimal(38,0)"))).first())
