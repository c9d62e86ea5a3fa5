"""Quality rules with cross-document line frequency.

A line is normalised to its words in lower case (A-Z), and hashed.  For each host
the distinct documents that hold a line are counted, copies of one text once.  A
line held by more than ``LIMIT_PERCENT`` of its host's distinct documents is
removed, whatever the host's size; ``MIN_DOCUMENTS`` only keeps a line and its one
copy from being a habit of a tiny host.  A document that loses more than
``DEPLETED_PERCENT`` of its words, or is left with fewer than ``MIN_WORDS``, is
rejected, as is one that fails the base rules (too few words, or mostly repeated
three-word windows).

Null text: as the empty text (no words, base rules failed).  Null hosts are one
host.  Repeated rows, null ids and rows sharing an id are separate documents with
one result row each; their equal texts count once for line frequency.  Other
columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textarrays as ta
from ledgerlens.llm.common import materialize

MIN_WORDS = 50
REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
MIN_DOCUMENTS = 2
LIMIT_PERCENT = 5
DEPLETED_PERCENT = 70

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", content long, lines array<long>, line_words array<int>"


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: does its value occur twice or more, and is this a later occurrence."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    later, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = equal
    often[order[1:]] |= equal
    often[order[:-1]] |= equal
    return often, later


def _salted(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return ta.mix(hashes + ta.mix(text.astype(np.uint64) + np.uint64(1)))


def _word_sequences(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each sequence of words ``first:last``."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(ta.mix(hashes) * ta.power(ta._BASE, len(hashes)), out=total[1:])
    return ta.mix((total[last] - total[first]) * ta.power(ta._INVERSE, len(hashes) + 1)[first] + (last - first).astype(np.uint64))


def lines(texts: ta.Texts) -> dict[str, np.ndarray]:
    """Lines with a word: byte bounds, words, raw and normalised hash, and the text of each."""
    start, end = ta.spans(texts.data != 10, texts.offsets)
    low = ta.words(texts, lower=True)
    first, last = np.searchsorted(low.start, start), np.searchsorted(low.start, end)
    some = last > first
    start, end, first, last = start[some], end[some], first[some], last[some]
    return {
        "start": start, "end": end, "words": last - first, "text": np.searchsorted(texts.offsets, start, side="right") - 1,
        "raw": ta.hash_spans(texts.data, start, end), "norm": _word_sequences(low.hash, first, last)}


def _measure(texts: ta.Texts) -> dict:
    w = ta.words(texts)
    n, data = len(texts), texts.data
    out = {
        "n_words": w.count, "n_symbols": _per_text(_SYMBOL[data], texts.offsets),
        "word_chars": _per_text(~ta.SPACE[data] & ((data & 0xC0) != 0x80), texts.offsets)}
    text_of_word = np.repeat(np.arange(n), w.count)
    starts, hashes = ta.windows(w, REPEAT_WINDOW)
    often, _ = _repeats(_salted(hashes, text_of_word[starts]))
    covered = np.zeros(len(w.hash), bool)
    for k in range(REPEAT_WINDOW):
        covered[starts[often] + k] = True
    out["n_repeat_words"] = _per_text(covered, w.first)
    ln = lines(texts)
    _, later = _repeats(_salted(ln["raw"], ln["text"]))
    out["n_dup_lines"] = np.bincount(ln["text"][later], minlength=n).astype(np.int64)
    out["content"] = ta.hash_spans(data, texts.offsets[:-1], texts.offsets[1:])
    out["lines"] = ln
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in ta.chunks(batch.column(2)):
            m = _measure(texts)
            ln, n = m["lines"], len(texts)
            bounds = pa.array(np.searchsorted(ln["text"], np.arange(n + 1)).astype(np.int32))
            columns = [batch.column(k).slice(texts.first, n) for k in (0, 1)] + [pa.array(m[c].astype(np.int64)) for c in _COUNTS]
            columns += [
                pa.array(m["content"].view(np.int64)),
                pa.ListArray.from_arrays(bounds, pa.array(ln["norm"].view(np.int64))),
                pa.ListArray.from_arrays(bounds, pa.array(ln["words"].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", *_COUNTS, "content", "lines", "line_words"])


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: a row number, the base counts, a content hash, and the hash and words of each line."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")]
    out = docs.select(*columns).mapInArrow(_measure_batches, _SCHEMA)
    return materialize(out.withColumn("row", F.monotonically_increasing_id()))


def limited_lines(measured: DataFrame) -> DataFrame:
    """(host, line) of the lines above the limits.

    One copy of each text per host is counted, so the count of a line is a plain
    sum that is combined before the shuffle.
    """
    once = measured.groupBy("host", "content").agg(F.min("row").alias("row"))
    hosts = once.groupBy("host").agg(F.count("*").alias("documents"))
    counted = measured.join(once.select("row"), "row", "left_semi").select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counted = counted.groupBy("host", "line").agg(F.count("*").alias("holders")).where(F.col("holders") > MIN_DOCUMENTS)
    at = counted["host"].eqNullSafe(hosts["host"])
    over = F.col("holders") * 100 > F.col("documents") * LIMIT_PERCENT
    return counted.join(hosts, at & over).select(counted["host"], "line")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, removed_words, removed_lines (hashes), kept."""
    measured = measure(docs, host)
    limited = limited_lines(measured).withColumnRenamed("host", "limited_host").withColumnRenamed("line", "limited_line")
    each = measured.where("size(lines) > 0").select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    each = each.select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hit = each.join(limited, (each["line"] == limited["limited_line"]) & each["host"].eqNullSafe(limited["limited_host"]))
    lost = hit.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    out = measured.drop("lines", "line_words").join(lost, "row", "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    depleted = (F.col("removed_words") * 100 > F.col("n_words") * DEPLETED_PERCENT) | (F.col("n_words") - F.col("removed_words") < MIN_WORDS)
    return out.select("doc_id", "host", "content", *_COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words", "removed_lines")


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts_out: list[str | None] = batch.column(1).to_pylist()
        removed = batch.column(2).to_pylist()
        for texts in ta.chunks(batch.column(1)):
            ln = lines(texts)
            for i in range(len(texts)):
                row = texts.first + i
                if not removed[row]:
                    continue
                gone, data = {x & (2**64 - 1) for x in removed[row]}, texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
                cuts = [(s - texts.offsets[i], e - texts.offsets[i]) for s, e, t, h in zip(ln["start"], ln["end"], ln["text"], ln["norm"]) if t == i and int(h) in gone]
                kept, at = b"", 0
                for s, e in cuts:
                    kept, at = kept + data[at:s], min(e + 1, len(data))
                texts_out[row] = (kept + data[at:]).decode()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_out, pa.string())], names=["doc_id", "text"])


def cleaned(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, text) of the kept documents without their limited lines.

    Rows that share a doc_id lose the lines that any of them loses.
    """
    verdict = judge(docs, host).where("kept").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("removed_lines", F.array().cast("array<long>"))))).alias("removed"))
    renamed = verdict.withColumnRenamed("doc_id", "kept_id")
    rows = docs.select("doc_id", "text").join(renamed, docs["doc_id"].eqNullSafe(renamed["kept_id"]))
    return rows.select("doc_id", "text", "removed").mapInArrow(_strip_batches, "doc_id long, text string")
