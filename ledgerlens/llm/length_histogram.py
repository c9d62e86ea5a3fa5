"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by encoded length, and suffix sums over the lengths
answer, for every context limit, how many documents and tokens there are, how
many documents are longer, and how many tokens remain if each document is cut at
the limit.  Quantiles follow from the running count.

Null text: as the empty text (length 0).  Repeated rows each count.  An empty
table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import tokens
from ledgerlens.llm.common import materialize

#: Lengths of one range of the two-level suffix sums.
RANGE = 4096


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(n_tokens) per row of ``docs(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            for _, _, bounds in encoder.encode(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds))], names=["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, documents) from ``lengths(n_tokens)``; counts are combined before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("documents"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """A row per length L that occurs, with what holds for a context limit of L.

    documents, tokens: of that length.  documents_at_most: not longer than L (for
    quantiles).  documents_longer, tokens_longer: longer than L.  truncated_tokens:
    the sum of min(length, L).  total_documents, total_tokens: of the table.

    Lengths are summed in ranges of ``RANGE`` and the ranges among themselves, so
    no task holds more than one range or the table of ranges.
    """
    counts = counts.withColumn("span", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("documents"))
    spans = counts.groupBy("span").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    spans = spans.select(
        F.col("span").alias("of_span"), F.coalesce(F.sum("d").over(above), zero).alias("d_above"), F.coalesce(F.sum("t").over(above), zero).alias("t_above"),
        F.sum("d").over(everything).alias("total_documents"), F.sum("t").over(everything).alias("total_tokens"))
    longer = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(spans, counts["span"] == spans["of_span"])
    out = out.withColumn("documents_longer", F.coalesce(F.sum("documents").over(longer), zero) + F.col("d_above"))
    out = out.withColumn("tokens_longer", F.coalesce(F.sum("tokens").over(longer), zero) + F.col("t_above"))
    return out.select(
        "n_tokens", "documents", "tokens", (F.col("total_documents") - F.col("documents_longer")).alias("documents_at_most"),
        "documents_longer", "tokens_longer",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("documents_longer")).alias("truncated_tokens"),
        "total_documents", "total_tokens")


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    return with_suffix_sums(materialize(histogram(encoded_lengths(docs, tokenizer))))


def truncated_total(counts: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens that remain of ``with_suffix_sums`` rows at any context limit, also one that no document has."""
    return counts.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("documents")).alias("truncated_tokens"))


def quantile(counts: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents does not exceed."""
    return counts.where(F.col("documents_at_most") >= F.ceil(F.col("total_documents") * F.lit(q))).agg(F.min("n_tokens").alias("n_tokens"))
