"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are fitted on labelled rows; each path from a root is a rule, a
conjunction of conditions on statistics.  A logistic regression with an L1
penalty weighs the rules and drops most of them.  The rest is compiled into one
Spark column expression, so scoring is a projection over the statistics.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of
doc_id; rows of the held-out fold (crc32 of doc_id as text, modulo 4, is 2) are
never among them.  Statistics cover whole texts.

Null text: as the empty text.  Null ids: scored, in no fold.  Repeated rows and
rows sharing an id: scored one by one; of several labels of one id the smallest
counts.  Null labels are ignored.  With labels of one kind only, the score is
that kind (0 or 1); without any labels it is 0.5.  Other columns are ignored,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import line_quality as lq
from ledgerlens.llm import textarrays as ta
from ledgerlens.llm.common import materialize

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 10, 3, 0.0005, 11
THRESHOLD = 0.7
HELD_OUT = 2

STATISTICS = [
    "n_words", "mean_word_chars", "symbol_share", "pipe_share", "upper_share", "digit_share", "mark_share", "stop_share", "repeat_share",
    "dup_line_share", "distinct_share", "words_per_line"]


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER_CASE = _is(bytes(range(65, 91))), _is(bytes(range(97, 123)))
_DIGIT, _PIPE, _MARK, _STOP = _is(b"0123456789"), _is(b"|"), _is(b"!?"), _is(b".,;:")


def _statistics(texts: ta.Texts) -> np.ndarray:
    m, data, off = lq._measure(texts), texts.data, texts.offsets
    count = lambda mask: lq._per_text(mask[data], off)
    n_words, chars = m["n_words"], m["word_chars"]
    w = ta.words(texts, lower=True)
    text_of_word = np.repeat(np.arange(len(texts)), w.count)
    _, later = lq._repeats(lq._salted(w.hash, text_of_word))
    distinct = n_words - np.bincount(text_of_word[later], minlength=len(texts))
    n_lines = np.bincount(m["lines"]["text"], minlength=len(texts))
    upper, lower = count(_UPPER), count(_LOWER_CASE)
    share = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        n_words, share(chars, n_words), share(m["n_symbols"], n_words), share(count(_PIPE), n_words), share(upper, upper + lower), share(count(_DIGIT), chars),
        share(count(_MARK), n_words), share(count(_STOP), n_words), share(m["n_repeat_words"], n_words), share(m["n_dup_lines"], n_lines),
        share(distinct, n_words), share(n_words, n_lines)]).astype(np.float64)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in ta.chunks(batch.column(1)):
            values = _statistics(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.first, len(texts)), *(pa.array(values[:, k]) for k in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS...) per row of ``docs(doc_id, text, ...)``."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(_statistics_batches, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, above the threshold?, threshold) that all hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            out = out & (F.col(name) > threshold if above else F.col(name) <= threshold)
        return out


_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)")


def paths(description: str) -> set[Rule]:
    """Every path from a root to a node below it, from the text form of tree models."""
    out, open_nodes = set(), []
    for line in description.splitlines():
        if m := _NODE.match(line):
            depth = len(m[1])
            open_nodes = [x for x in open_nodes if x[0] < depth]
            open_nodes.append((depth, (STATISTICS[int(m[3])], m[4] == ">", float(m[5]))))
            out.add(Rule(tuple(x[1] for x in open_nodes)))
        elif line.strip().startswith("Tree"):
            open_nodes = []
    return out


@dataclass(frozen=True)
class Model:
    """Score = 1 / (1 + exp(-(intercept + the weights of the rules that hold))); ``constant`` overrides it."""

    rules: tuple[tuple[Rule, float], ...] = ()
    intercept: float = 0.0
    constant: float | None = None

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """The model from ``labels(doc_id, quality)`` and the statistics of the same ids."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = materialize(measured.join(known, "doc_id"))
    kinds = [r[0] for r in rows.groupBy("label").count().orderBy("label").collect()]
    if len(kinds) < 2:
        return Model(constant=kinds[0] if kinds else 0.5)
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=5).fit(vectors)
    rules = sorted(paths(forest.toDebugString), key=lambda r: r.conditions)
    if not rules:
        return Model(constant=rows.agg(F.avg("label")).first()[0])
    held = rows.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if w]
    return Model(tuple(weights), float(fitted.intercept))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; predicted is 1 where score >= 0.7."""
    measured = materialize(statistics(docs))
    score = fit(measured, labels).score()
    out = measured.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
