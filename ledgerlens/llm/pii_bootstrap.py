"""Personal data in texts: fixed patterns, and bootstrapped contextual extraction.

Fixed patterns (the base) find e-mail addresses, IP addresses, card and phone
numbers.  They are the seeds.  What stands around a seed is its lexical patterns:
the two words before it, the word before it, and the words on both sides.  The
same patterns are taken for every candidate, a run of non-space characters that
looks like an identifier (``LEAST_DIGITS`` digits or an ``@``, ``LENGTHS``
characters, no base span).  Patterns and instances (the distinct identifiers)
make a bipartite graph, which Spark scores in rounds:

* a pattern's confidence is the share of its places in the whole corpus that hold
  an instance, weighted by the instances' scores; it counts from ``SUPPORT``
  different likely instances and ``PATTERN_CONFIDENCE`` on;
* an instance's score is one minus the product of (1 - confidence) over its
  patterns; a seed's is 1.

Instances found in one round support new patterns in the next.  Non-seeds that
reach ``INSTANCE_SCORE`` are identifiers that no fixed pattern knew, and each of
their places is a span of kind ``found``.

Places of a pattern are counted over all words of all texts.  A share is at most
that of all candidates, so patterns that can't reach the confidence with every
candidate scored 1 are left out before the rounds, without changing the result.
Places are counted only for keys in a bitmap of the candidates' patterns, whose
size is bounded (``common.BITMAP_BITS``); a full bitmap lets more keys through, which the
join then drops.

Null text: as the empty text, without spans.  Null ids, repeated rows and rows
sharing an id: one result row each, each with its own places.  Columns other than
doc_id and text are ignored, whatever their names.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textarrays as ta
from ledgerlens.llm.common import bitmap, materialize

KINDS = ["email", "ip", "card", "phone", "found"]
#: A candidate's digits (fewer with an @) and its length.
LEAST_DIGITS, LENGTHS = 4, (6, 64)
#: Different likely instances that a pattern needs, and its least confidence.
SUPPORT, PATTERN_CONFIDENCE = 3, 0.6
#: Score from which an instance is likely and is reported.
INSTANCE_SCORE = 0.75
ROUNDS = 4
#: Pattern keys whose counts a task holds before it sums or sends them.
HELD_KEYS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its beginning on fails from inside too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of e-mail addresses: each @ with what may stand before it, so that long runs without one cost nothing."""
    at, cursor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        cursor = at + 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            cursor = domain.end()
        at = text.find("@", cursor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# letters, digits and every byte beyond ASCII are of words; all else parts them
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_TAG = np.array([0x51ED270B9F3C8A11, 0x2F6E2B1D0A4C7793, 0x7C15A2E94D3B60F5], np.uint64)


class Surroundings:
    """Words around places of some texts; a place is (text, first byte, byte after the last)."""

    def __init__(self, texts: ta.Texts):
        self.data = ta.LOWER[texts.data]
        self.start, self.end = ta.spans(_WORD_BYTE[self.data], texts.offsets)
        self.hash = ta.hash_spans(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, texts.offsets)

    def keys(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Three pattern keys of each place, which of them there are, and the places of the words before and after."""
        before = np.searchsorted(self.end, start, side="right") - 1
        after = np.searchsorted(self.start, end)
        h = np.append(self.hash, np.zeros(2, np.uint64))
        one, two, behind = h[before], h[before - 1], h[np.minimum(after, len(self.hash))]
        has_one, has_two = before >= self.first[text], before - 1 >= self.first[text]
        left = ta.mix(one + _TAG[0])
        keys = np.stack([ta.mix(ta.mix(two + _TAG[1]) * _TAG[2] + one), left, ta.mix(left * _TAG[1] + ta.mix(behind + _TAG[2]))])
        return keys, np.stack([has_two, has_one, has_one & (after < self.first[text + 1])]), before, after

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()

    def patterns(self, before: int, after: int) -> list[str]:
        """The patterns of one place in words."""
        one = self.word(before) if before >= 0 else ""
        return [f"{self.word(before - 1) if before > 0 else ''} {one} _", f"{one} _", f"{one} _ {self.word(after) if after < len(self.start) else ''}"]


def _trimmed(raw: str) -> tuple[int, int]:
    """Bounds of the identifier in a run of characters: behind the last : or =, from the first to the last letter, digit or +."""
    start = max(raw.rfind(":"), raw.rfind("=")) + 1
    end = len(raw)
    while start < end and not (raw[start].isalnum() or raw[start] == "+"):
        start += 1
    while end > start and not raw[end - 1].isalnum():
        end -= 1
    return start, end


def normal(value: str) -> str:
    """What tells identifiers apart: letters in lower case, digits, and @."""
    return "".join(c for c in value.lower() if c.isalnum() or c == "@")


_SCAN = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
    "places array<struct<start:int,end:int,value:string,seed:boolean,patterns:array<struct<key:long,words:string>>>>")


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _places(texts: ta.Texts, around: Surroundings) -> tuple[list, list]:
    """Base spans and places (of seeds and candidates) of each text."""
    data, offsets = texts.data, texts.offsets
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    ats = np.concatenate([[0], np.cumsum(data == 64)])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    bases, places = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
    strings: dict[int, str] = {}
    kept = []  # (text, first byte, byte after, start, end, is a seed)
    for i in np.flatnonzero((np.diff(digits[offsets]) > 3) | (np.diff(ats[offsets]) > 0)).tolist():
        strings[i] = data[offsets[i] : offsets[i + 1]].tobytes().decode()
        bases[i] = base_spans(strings[i])
        if bases[i]:
            zero = points[offsets[i]]
            # the place of code point k of the corpus is the last byte with k code points before it
            first = np.searchsorted(points, [zero + s for s, _, _ in bases[i]], side="right") - 1
            after = np.searchsorted(points, [zero + e for _, _, e in bases[i]], side="right") - 1
            kept += [(i, a, b, s, e, True) for a, b, (s, _, e) in zip(first.tolist(), after.tolist(), bases[i])]
    start, end = ta.spans(~ta.SPACE[data], offsets)
    like = (end - start <= 4 * LENGTHS[1]) & ((digits[end] - digits[start] >= LEAST_DIGITS) | (ats[end] - ats[start] > 0))
    text_of = np.searchsorted(offsets, start, side="right") - 1
    next_base = dict.fromkeys(strings, 0)
    for a, b, i in zip(start[like].tolist(), end[like].tolist(), text_of[like].tolist()):
        raw = data[a:b].tobytes().decode()
        lo, hi = _trimmed(raw)
        s = int(points[a] - points[offsets[i]]) + lo
        e, at, base = s + hi - lo, next_base[i], bases[i]
        while at < len(base) and base[at][2] <= s:
            at += 1
        next_base[i] = at
        value = raw[lo:hi]
        if LENGTHS[0] <= hi - lo <= LENGTHS[1] and (sum(c.isdigit() for c in value) >= LEAST_DIGITS or "@" in value) and not (at < len(base) and base[at][0] < e):
            kept.append((i, a + len(raw[:lo].encode()), a + len(raw[:hi].encode()), s, e, False))
    if kept:
        text, first, after = (np.array([k[c] for k in kept]) for c in range(3))
        keys, there, before, behind = around.keys(text, first, after)
        signed = keys.view(np.int64)
        for j, (i, _, _, s, e, seed) in enumerate(kept):
            words = around.patterns(int(before[j]), int(behind[j]))
            patterns = [{"key": int(signed[f, j]), "words": words[f]} for f in range(3) if there[f, j]]
            places[i].append({"start": s, "end": e, "value": normal(strings[i][s:e]), "seed": seed, "patterns": patterns})
    return bases, places


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema([
        ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
        ("places", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seed", pa.bool_()),
                                       ("patterns", pa.list_(pa.struct([("key", pa.int64()), ("words", pa.string())])))])))])
    for batch in batches:
        for texts in ta.chunks(batch.column(1)):
            bases, places = _places(texts, Surroundings(texts))
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in bases], pa.int64()) for kind in range(4)]
            sha = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in bases]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.first, len(texts)), *counts, pa.array(sha, pa.string()),
                 pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in bases], types.field("base").type), pa.array(places, types.field("places").type)],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "places"])


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, counts, base_sha256, base, places) per row, written once; row: its number in the written table."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan_batches, _SCAN)
    return materialize(out.withColumn("row", F.monotonically_increasing_id()))


def key_bits(keys: DataFrame) -> np.ndarray:
    """The bitmap of ``keys(key)`` as bytes."""
    bits, parts = bitmap(keys)
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # one row per 32,768 bits
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)


def _counts(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def pattern_places(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, total): how many places of all texts each pattern of ``keys(key)`` has."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(key_bits(keys).tobytes())

    def kept_of(texts: ta.Texts, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        around = Surroundings(texts)
        start, end = ta.spans(~ta.SPACE[texts.data], texts.offsets)
        text = np.searchsorted(texts.offsets, start, side="right") - 1
        found, there, _, _ = around.keys(text, start, end)
        found = found[there]
        at = found & np.uint64(8 * len(bits) - 1)
        found = found[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return np.unique(found, return_counts=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        keys, times, held = [], [], 0  # a task's counts are summed before they leave it
        for texts in (texts for batch in batches for texts in ta.chunks(batch.column(0))):
            key, n = kept_of(texts, bits)
            keys.append(key)
            times.append(n)
            held += len(key)
            if held > HELD_KEYS:
                key, n = _summed(keys, times)
                keys, times, held = [key], [n], len(key)
                if held > HELD_KEYS // 2:
                    yield _counts(key, n)
                    keys, times, held = [], [], 0
        if held:
            yield _counts(*_summed(keys, times))

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("total")).join(keys, "key", "left_semi")


def graph(docs: DataFrame, scan: DataFrame) -> DataFrame:
    """(key, words, value, seed, times, total): edges of the patterns that can reach the confidence."""
    place = scan.select(F.explode("places").alias("p")).select("p.value", "p.seed", F.explode("p.patterns").alias("pattern"))
    edges = materialize(place.groupBy(F.col("pattern.key").alias("key"), "value").agg(
        F.min("pattern.words").alias("words"), F.max("seed").alias("seed"), F.count("*").alias("times")))
    patterns = edges.groupBy("key").agg(F.count("*").alias("instances"), F.sum("times").alias("held")).where(F.col("instances") >= SUPPORT)
    patterns = materialize(patterns)
    total = pattern_places(docs, patterns.select("key"))
    # a seed of several words has no word that is its place, so there may be fewer places than instances
    patterns = patterns.join(total, "key", "left").withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), "held"))
    able = patterns.where(F.col("held") / (F.col("total") + 1) >= PATTERN_CONFIDENCE).select("key", "total")
    return materialize(edges.join(able, "key"))


def _unlikely(confidence: Column) -> Column:
    """log(1 - confidence), finite."""
    return F.log(F.greatest(F.lit(1e-12), F.lit(1.0) - confidence))


def scores(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(value, seed, score) of the graph's instances and (key, words, total, support, confidence) of its patterns after all rounds."""
    score = edges.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        held = edges.join(score.select("value", "score"), "value")
        likely = F.count_if(F.col("score") >= INSTANCE_SCORE)
        pattern = held.groupBy("key", "total").agg(F.min("words").alias("words"), likely.alias("support"), F.sum(F.col("times") * F.col("score")).alias("mass"))
        confident = pattern.withColumn("confidence", F.col("mass") / (F.col("total") + 1))
        pattern = materialize(confident.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= PATTERN_CONFIDENCE)).drop("mass"))
        by_value = edges.join(pattern.select("key", "confidence"), "key", "left").groupBy("value").agg(
            F.max("seed").alias("seed"), F.sum(_unlikely(F.coalesce("confidence", F.lit(0.0)))).alias("unlikely"))
        score = materialize(by_value.select("value", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(1 - F.exp("unlikely")).alias("score")))
    return score, pattern


def induced_patterns(docs: DataFrame) -> DataFrame:
    """(words, total, support, confidence) of the patterns that the seeds led to; _ is where the identifier stands."""
    scan = scanned(docs)
    return scores(graph(docs, scan))[1].drop("key")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans) per row of ``docs(doc_id, text, ...)``.

    spans: kind:start:end by start, then kind, comma-joined; code points, end exclusive.
    """
    scan = scanned(docs)
    score, _ = scores(graph(docs, scan))
    accepted = score.where(~F.col("seed") & (F.col("score") >= INSTANCE_SCORE)).select(F.col("value").alias("accepted"))
    place = scan.select("row", F.explode("places").alias("p")).where(~F.col("p.seed")).join(accepted, F.col("p.value") == F.col("accepted"))
    found = place.groupBy("row").agg(F.collect_list(F.struct(F.col("p.start").alias("start"), F.lit(4).alias("kind"), F.col("p.end").alias("end"))).alias("found"))
    out = scan.drop("places").join(found, "row", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    listed = F.transform(F.array_sort(F.concat("base", found)), lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size(found).cast("long").alias("n_found"), "base_sha256", F.array_join(listed, ",").alias("spans"))
