"""Language identification by interpolated Kneser-Ney character models.

A text is read as its letters in lower case with the marks that follow them (vowel
signs, accents), every run of other characters as one space.  Symbols are UTF-16
units, so a letter beyond U+FFFF is two symbols that nothing else shares.  For each language the four-character sequences of all its learning texts
are counted; lower orders hold continuation counts (in how many contexts a
sequence occurs).  Probabilities are interpolated from order 4 down to 1 and a
uniform share.  The model is a table: for each language and order its sequences
with their discounted share, and its contexts with the weight of the order
below, under the whole 64-bit sequence, so no two sequences share an entry
however large the corpus is.  A model of up to ``LOCAL_ROWS`` entries is sent to
every task as sorted arrays.  A larger one stays a table: the distinct sequences
of the documents are joined to it order by order, and each document's sequences
to the logarithms that come out.  Both ways give the same results.

The language with the lowest cross-entropy per character is chosen.  Each
language has a limit, calibrated on its learning texts (mean plus ``SPREAD``
standard deviations); a text above the limit of its language is marked as not
accepted, and keeps its prediction.

Learning texts: rows with a text and a language outside the held-out fold (crc32
of doc_id as text, modulo 4, is 2), all of them.

Null text, or text without letters: ``und`` with score 0, not accepted.  Without
learning texts, all rows are ``und``.  Null ids: predicted, in no fold, and not
learned from.  Repeated rows each count.  Other columns are ignored, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textarrays as ta
from ledgerlens.llm.common import materialize

ORDER = 4
#: Entries of a model that tasks hold as arrays (16 bytes each); a larger one is joined.
LOCAL_ROWS = 2_000_000
CHUNK_BYTES = 1 << 20
HELD_OUT = 2
UNKNOWN = "und"
SPREAD = 4.0
#: Characters that a score's evidence counts at most.
EVIDENCE = 30
_SPACE = 32


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: the code point of its lower-case letter, or 32 for what is no letter; and whether it is a mark."""
    table, mark = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        kind = unicodedata.category(x)
        if kind[0] == "L":
            low = x.lower()
            table[c] = ord(low if len(low) == 1 else x)
        mark[c] = kind in ("Mn", "Mc")
    return table, mark


def _symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The letter of each code point, a mark itself where it follows a letter, else 32; ``starts``: first points of texts."""
    table, is_mark = _letters()
    out = table[points]
    mark = is_mark[points]
    if mark.any():
        at = np.arange(len(points))
        letter = np.maximum.accumulate(np.where(out != _SPACE, at, -1))
        other = np.where((out == _SPACE) & ~mark, at, -1)
        other[starts] = np.maximum(other[starts], starts - 1)
        out = np.where(mark & (letter > np.maximum.accumulate(other)), points, out)
    return out


def _units(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit units of the symbols, and how many each has."""
    wide = symbols > 0xFFFF
    n = 1 + wide.astype(np.int64)
    if not wide.any():
        return symbols.astype(np.uint64), n
    out = np.repeat(symbols, n).astype(np.uint64)
    last = np.cumsum(n)[wide] - 1
    above = symbols[wide].astype(np.uint64) - np.uint64(0x10000)
    out[last - 1], out[last] = np.uint64(0xD800) + (above >> np.uint64(10)), np.uint64(0xDC00) + (above & np.uint64(0x3FF))
    return out, n


def sequences(texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the four-symbol sequences of all texts, and the text of each.

    A key packs four 16-bit symbols, the last one lowest.  A text starts after spaces; one without letters has no sequences.
    """
    points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=begins[1:])
    offsets = begins[texts.offsets]
    starts = offsets[:-1][offsets[:-1] < len(points)]
    symbols = _symbols(points, starts)
    letter = symbols != _SPACE
    before = np.zeros(len(letter), bool)
    before[1:] = letter[:-1]
    before[starts] = False
    keep = np.flatnonzero(letter | before)
    units, n = _units(symbols[keep])
    of_text = np.repeat(np.searchsorted(offsets, keep, side="right") - 1, n)
    first = np.searchsorted(of_text, np.arange(len(texts)))
    pads = np.repeat(first, ORDER - 1)
    padded = np.insert(units, pads, _SPACE)
    at = np.arange(len(units)) + (ORDER - 1) * (of_text + 1)
    key = np.zeros(len(units), np.uint64)
    for back in range(ORDER):
        key |= padded[at - back] << np.uint64(16 * back)
    return key, of_text


def learns() -> Column:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return F.coalesce((fold != HELD_OUT) & F.col("lang").isNotNull(), F.lit(False))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, summed before they leave it."""
    held: dict[str, list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for texts in ta.chunks(batch.column(1), CHUNK_BYTES):
            keys, of_text = sequences(texts)
            own = langs[texts.first : texts.first + len(texts)]
            names, number = np.unique(own.astype(str), return_inverse=True)
            of_key = number[of_text]
            for k, lang in enumerate(names):
                values, n = np.unique(keys[of_key == k], return_counts=True)
                parts = held.setdefault(str(lang), [])
                parts.append((values, n))
                if len(parts) >= 8:
                    held[str(lang)] = [_merged(parts)]
        if sum(len(k) for parts in held.values() for k, _ in parts) > 4_000_000:
            yield from flush()
    yield from flush()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n): how often each four-symbol sequence occurs in the learning texts."""
    rows = docs.where(learns()).where("text is not null").select("lang", "text")
    return rows.mapInArrow(_count_batches, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def model_rows(counted: DataFrame) -> DataFrame:
    """(lang, order, context, key, value) of the interpolated model from ``counts``."""
    level, out = counted, None
    for order in range(ORDER, 0, -1):
        once, twice = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
        discount = level.groupBy("lang").agg(F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5)))).alias("d"))
        keyed = level.join(F.broadcast(discount), "lang").withColumn("before", F.shiftrightunsigned("key", 16))  # one row per language
        contexts = keyed.groupBy("lang", "before").agg(F.sum("n").alias("total"), (F.max("d") * F.count("*") / F.sum("n")).alias("value"))
        shares = keyed.join(contexts.select("lang", "before", "total"), ["lang", "before"]).select("lang", "key", ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
        rows = shares.withColumn("context", F.lit(False)).unionByName(contexts.select("lang", F.col("before").alias("key"), "value", F.lit(True).alias("context")))
        rows = rows.select("lang", F.lit(order).alias("order"), "context", "key", "value")
        out = rows if out is None else out.unionByName(rows)
        low = (1 << 16 * (order - 1)) - 1
        level = materialize(level.groupBy("lang", F.col("key").bitwiseAND(F.lit(low)).alias("key")).agg(F.count("*").alias("n")))
    return out


class Model:
    """Sorted arrays of sequences by language, order and kind."""

    def __init__(self, rows: pa.Table):
        names = rows.column("lang").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        held = names.dictionary.to_pylist()
        lang = names.indices.to_numpy(zero_copy_only=False)
        order, context = rows.column("order").to_numpy(), rows.column("context").to_numpy()
        keys, values = rows.column("key").to_numpy().astype(np.int64).view(np.uint64), rows.column("value").to_numpy()
        self.langs: list[str] = sorted(held)
        self.arrays: dict[tuple[int, int, bool], tuple[np.ndarray, np.ndarray]] = {}
        symbols = set()
        for k, name in enumerate(self.langs):
            for n in range(1, ORDER + 1):
                for c in (False, True):
                    mine = np.flatnonzero((lang == held.index(name)) & (order == n) & (context == c))
                    mine = mine[np.argsort(keys[mine])]
                    self.arrays[k, n, c] = keys[mine], values[mine]
            symbols.update(self.arrays[k, 1, False][0].tolist())
        self.uniform = 1 / (len(symbols) + 1)

    def _find(self, k: int, order: int, context: bool, wanted: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.arrays[k, order, context]
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each sequence's last symbol (languages x keys)."""
        out = np.empty((len(self.langs), len(keys)))
        for k in range(len(self.langs)):
            p = np.full(len(keys), self.uniform)
            for order in range(1, ORDER + 1):
                part = keys & np.uint64((1 << 16 * order) - 1)
                share = self._find(k, order, False, part, 0.0)
                p = share + self._find(k, order, True, part >> np.uint64(16), 1.0) * p
            out[k] = np.log(p)
        return out


def _scored(model: Model, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for texts in ta.chunks(batch.column(1), CHUNK_BYTES):
        keys, of_text = sequences(texts)
        distinct, back = np.unique(keys, return_inverse=True)
        n = np.bincount(of_text, minlength=len(texts))
        name, score, entropy = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        some = n > 0
        if model.langs and some.any():
            logs = model.log_probabilities(distinct)
            total = np.array([np.bincount(of_text, row[back], minlength=len(texts)) for row in logs])
            mean = -total[:, some] / n[some]
            best = mean.argmin(0)
            weight = np.exp((mean.min(0) - mean) * np.minimum(n[some], EVIDENCE))
            name[some] = np.array(model.langs, object)[best]
            score[some], entropy[some] = 1 / weight.sum(0), mean.min(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(texts.first, len(texts)), batch.column(2).slice(texts.first, len(texts)), batch.column(3).slice(texts.first, len(texts)),
             pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(entropy, from_pandas=True)],
            names=["doc_id", "held_out", "taught", "lang_pred", "score", "entropy"])


def log_table(model: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, key, log): for each language of ``model_rows`` the natural logarithm that ``Model`` gives each of ``wanted(key)``.

    Goes up the orders, over the distinct endings of the wanted sequences: an
    entry is joined by at most as many sequences as there are symbols.
    """
    langs = model.select("lang").distinct()
    below = None
    for order in range(1, ORDER + 1):
        mask = (1 << 16 * order) - 1 if order < ORDER else -1
        asked = wanted.select(F.col("key").bitwiseAND(F.lit(mask).cast("long")).alias("key")).distinct().crossJoin(F.broadcast(langs))
        asked = asked.withColumn("before", F.shiftrightunsigned("key", 16)).withColumn("ending", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("long")))
        here = model.where(F.col("order") == order)
        shares = here.where("not context").select("lang", "key", F.col("value").alias("share"))
        weights = here.where("context").select("lang", F.col("key").alias("before"), F.col("value").alias("weight"))
        at = asked.join(shares, ["lang", "key"], "left").join(F.broadcast(weights) if order == 1 else weights, ["lang", "before"], "left")
        if below is None:
            symbols = shares.select("key").distinct().agg(F.count("*").alias("symbols"))
            at = at.crossJoin(F.broadcast(symbols.select((1 / (F.col("symbols") + 1)).alias("lower"))))
        else:
            at = at.join(below.select("lang", F.col("key").alias("ending"), F.col("p").alias("lower")), ["lang", "ending"])
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("lower")
        below = materialize(at.select("lang", "key", p.alias("p")))
    return below.select("lang", "key", F.log("p").alias("log"))


def _tally_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct sequences and how often it holds them."""
    for batch in batches:
        for texts in ta.chunks(batch.column(1), CHUNK_BYTES):
            keys, of_text = sequences(texts)
            order = np.lexsort((keys, of_text))
            keys, of_text = keys[order], of_text[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (of_text[1:] != of_text[:-1])
            first = np.flatnonzero(new)
            bounds = pa.array(np.searchsorted(of_text[first], np.arange(len(texts) + 1)).astype(np.int32))
            times = np.diff(np.append(first, len(keys))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(texts.first, len(texts)) for k in (0, 2, 3)), pa.array(np.bincount(of_text, minlength=len(texts)).astype(np.int64)),
                 pa.ListArray.from_arrays(bounds, pa.array(keys[first].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times))],
                names=["doc_id", "held_out", "taught", "n", "keys", "times"])


_SCORED = "doc_id long, held_out boolean, taught string, lang_pred string, score double, entropy double"


def _scored_here(model: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores by arrays that every task holds."""
    held = rows.sparkSession.sparkContext.broadcast(Model(model.toArrow()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _scored(held.value, batch)

    return rows.mapInArrow(score, _SCORED)


def _scored_by_join(model: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores by joins with the model's table; nothing of it is gathered."""
    tally = rows.mapInArrow(_tally_batches, "doc_id long, held_out boolean, taught string, n long, keys array<long>, times array<long>")
    tally = materialize(tally.withColumn("row", F.monotonically_increasing_id()))
    each = tally.select("row", "n", F.explode(F.arrays_zip("keys", "times")).alias("e")).select("row", "n", F.col("e.keys").alias("key"), F.col("e.times").alias("times"))
    logs = log_table(model, materialize(each.select("key").distinct()))
    mean = each.join(logs, "key").groupBy("row", "lang").agg((-F.sum(F.col("times") * F.col("log")) / F.max("n")).alias("mean"), F.max("n").alias("n"))
    best = mean.groupBy("row").agg(F.min(F.struct("mean", "lang")).alias("best"), F.max("n").alias("of"), F.collect_list("mean").alias("means"))
    weight = F.aggregate("means", F.lit(0.0), lambda total, x: total + F.exp((F.col("best.mean") - x) * F.least(F.col("of"), F.lit(EVIDENCE))))
    best = best.select("row", F.col("best.lang").alias("lang_pred"), (1 / weight).alias("score"), F.col("best.mean").alias("entropy"))
    out = tally.select("row", "doc_id", "held_out", "taught").join(best, "row", "left")
    return out.select("doc_id", "held_out", "taught", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), "entropy")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, accepted) per row of ``docs(doc_id, text, lang, ...)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = materialize(model_rows(materialize(counts(docs))))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"), F.when(learns(), F.col("lang")).alias("taught"))
    scored = materialize(_scored_here(model, rows) if model.count() <= LOCAL_ROWS else _scored_by_join(model, rows))
    limits = scored.where("taught = lang_pred").groupBy(F.col("lang_pred").alias("of_lang")).agg(
        (F.avg("entropy") + SPREAD * F.coalesce(F.stddev_pop("entropy"), F.lit(0.0))).alias("most"))
    out = scored.join(limits, scored["lang_pred"] == limits["of_lang"], "left")
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", F.coalesce(F.col("entropy") <= F.col("most"), F.lit(False)).alias("accepted"))
