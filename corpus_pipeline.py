"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet and rereads it as the next stage's documents.  All stages but the last
return the columns of ``documents``.  The operators define what nulls, empty
texts, ties, repeated rows and empty tables give; see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import minhash_dedup, mixing, packing, rule_ensemble, secret_scan
from ledgerlens.llm.common import materialize, maybe_in, read
from ledgerlens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _flagged(docs: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose doc_id is surely not in ``flags(id, flag)``, and the others with their flag, null if there is none.

    Only the others are shuffled; a null id is matched too.
    """
    rows = maybe_in(docs.select(*COLUMNS), "doc_id", flags)
    others = rows.where("maybe").join(flags, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return rows.where("not maybe").select(*COLUMNS), others


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as good; rows sharing an id go together, and stay if one is good."""
    scored = rule_ensemble.classify(docs, read(spark, sf_dir, "labels"))
    bad = scored.groupBy(F.col("doc_id").alias("id")).agg(F.max("predicted").alias("flag")).where("flag = 0")
    clean, others = _flagged(docs, materialize(bad))
    return clean.unionByName(others.where("flag is null").select(*COLUMNS))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with its smallest id; of rows that share an id and a text, one."""
    found = minhash_dedup.near_duplicates(docs).groupBy(F.col("doc_id").alias("id")).agg(F.every("kept").alias("kept"), F.count("*").alias("rows"))
    flags = materialize(found.where("not kept or rows > 1").select("id", F.when(F.col("kept"), "twins").otherwise("copy").alias("flag")))
    alone, others = _flagged(docs, flags)
    twin = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars")
    first = others.where("flag = 'twins'").withColumn("twin", F.row_number().over(twin)).where("twin = 1")
    return alone.unionByName(others.where("flag is null").select(*COLUMNS)).unionByName(first.select(*COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars is that of the masked text (null for a null text)."""
    masked = secret_scan.masked(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; partial ones hold the words taken."""
    return mixing.mixture(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most 1024 tokens."""
    return packing.packed_digest(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing, fitted rules and seeded places can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
