"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy.

Patterns (the base) give spans of three kinds: an assignment to a secret-like
name, an access key id, and a long lower-case hexadecimal run.  On top of them
every candidate string (a run of ``A-Za-z0-9+/_=-``) of at least ``LEAST``
characters is read by a sliding window of ``WINDOW`` characters, or of its own
length if that is less.  A candidate's character class (digits and a-f or A-F:
hex; letters; letters and digits: alnum; otherwise base64) sets the entropy that
a window must reach; for shorter windows it shrinks with the largest entropy
that they can have.  The window's entropy is kept by incremental counts: a step
changes the counts of the character that leaves and the one that enters, and the
sum of c * log2(c) with them.

Prose reaches these limits too.  So a window counts if it also holds several
digits beside letters and is not made of words, or if its characters follow each
other as they don't in words: ``surprise`` sums what each pair costs beyond the
usual, in bits.  A candidate with such a window is a span of kind ``entropy`` as
a whole, since a secret goes on beside its windows that count; candidates inside
a base span, or on the allow list, are dropped.

Null text: as the empty text, without spans.  Null ids, repeated rows and rows
sharing an id: one result row each.  Other columns are ignored, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20
#: Characters of the shortest candidate: below, chance and words can't be told apart.
LEAST = 8
#: Least entropy (bits a character) of a window, by class of its candidate.
LIMITS = {"hex": 3.0, "letters": 3.2, "alnum": 3.6, "base64": 3.6}
#: Least digits and letters in a window that counts whatever its surprise.
LEAST_DIGITS, LEAST_LETTERS = 3, 3
MASK = "[SECRET]"

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_IS_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_IS_ALNUM = re.compile(r"[A-Za-z0-9]+")
#: Letters joined by marks: no secrets for their digits beside letters, but for their surprise.
_WORDS = re.compile(r"[A-Za-z]+([-_/+=]+[A-Za-z]+)*[-_/+=]*[0-9]{0,4}")

#: Candidates that are no secrets: identifiers of fixed form, and plain sequences.
ALLOWED = [
    re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE),  # UUID
    re.compile(r"[0-9]+([-_/+=][0-9]+)*"),  # numbers, dates
]
#: A date before a name; what follows is scanned by itself.
_DATE = re.compile(r"(19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?=[-_/+=])[-_/+=]*")
_SEQUENCES = "0123456789abcdefghijklmnopqrstuvwxyz0123456789"

_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # a character enters before one leaves

#: Bits above which a window's surprise is no word's: the clean words at sf0.1 that were not learned from stay below 11.
SURPRISE = 14.0
#: Bits that a pair of characters costs on average in words; a pair in hex costs what two digits do.
_USUAL, _USUAL_HEX = 3.9, 3.4
#: Quarter bits (base 36) of each letter (column) after each letter (row): half the documents of sf0.1 and English manuals.
_PAIRS = (
    "mkhjlsnqiurglanmtegbhqqtrv hoor9ttsipv6steqvljqjvwumu hwotgvw5fwkktubuvmsgmvwwrw fnrn8sslauwltlbtwjhhksovrw fqjeipppivujmbnoradiqprntr eoqqbhqlcwsktpbsvemdjrswps "
    "cnrv7unhgwtjsihqwghjjpqwtr anst8trlewsmqldswkkgospwpt kognepntrvvkl7cptmhdvmutwo 4wqwdwwwqwwwwqewwwww9wwwqw lupp3rnwfwwkukqsutftqumwtw etro7tuvcvudtuhsvunnotwwaw "
    "emts5uvv9wusmsifwtntmvvwsw gniddpbmiupnslhqtnfaoopwst ppllqgpumuqlj7mlucildontuv 9uusf7wplwuhvthkwfokmuvwpw sswswwwswwwssswwwoww1wwwww dnmo7romfvqnmlfpujhgoqpwpt "
    "jqercsrcgssnoqjlrnh8ivrwpw fqptbtua9wunsphrvgikntqvom hilraqoojwshjbkktghfsrsgwt etvw4uqv8wwwuuiqvwtuvvvwtt duusgtw5dwwntiiwwilrwwsqww dqfobqwqfwwklwfdlirbukwuss "
    "hlnpcrpiewwileeguheewnkwrq emis8wpqfsqonrjqsnmk8qwwto"
).split()


def _cost(a: str, b: str) -> float:
    if a.isalpha() and b.isalpha():
        return int(_PAIRS[ord(a.lower()) - 97][ord(b.lower()) - 97], 36) / 4 + (3.0 if a.islower() and b.isupper() else 0.0)
    if b.isdigit():
        return 3.4 if a.isdigit() else 8.5 if a.isalpha() else 6.5
    if b.isalpha():
        return 8.5 if a.isdigit() else 4.7
    return 3.0 if b in "-_/" else 7.0


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_COSTS = {a + b: _cost(a, b) for a in _ALPHABET for b in _ALPHABET}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def allowed(candidate: str) -> bool:
    return any(p.fullmatch(candidate) for p in ALLOWED) or candidate.lower() in _SEQUENCES


def window_spans(candidate: str) -> list[tuple[int, int]]:
    """Unions of the candidate's windows that reach the limit of its class."""
    kind = "hex" if _IS_HEX.fullmatch(candidate) else "alnum" if _IS_ALNUM.fullmatch(candidate) else "base64"
    limit, counts, total, digits, letters = LIMITS[kind], {}, 0.0, 0, 0
    out: list[tuple[int, int]] = []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _LOG[n + 1] - _LOG[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= WINDOW:
            gone = candidate[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total += _LOG[n - 1] - _LOG[n]
            digits -= gone.isdigit()
            letters -= gone.isalpha()
        if i >= WINDOW - 1 and digits >= LEAST_DIGITS and letters >= LEAST_LETTERS and math.log2(WINDOW) - total / WINDOW >= limit - 1e-9:
            start = i - WINDOW + 1
            if out and out[-1][1] >= start:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def surprise(candidate: str) -> list[float]:
    """Of each window, the bits by which its characters cost more than those of words do."""
    usual = _USUAL_HEX if _IS_HEX.fullmatch(candidate) and not candidate.isalpha() else _USUAL
    extra = [0.0]
    for a, b in zip(candidate, candidate[1:]):
        extra.append(extra[-1] + _COSTS[a + b] - usual)
    size = min(WINDOW, len(candidate))
    return [extra[i + size - 1] - extra[i] for i in range(len(candidate) - size + 1)]


def surprising(candidate: str) -> bool:
    """Has the candidate a window that reaches the limit of its class and is no words by its surprise?"""
    bits, size = surprise(candidate), min(WINDOW, len(candidate))
    if max(bits) <= SURPRISE:
        return False
    kind = "letters" if candidate.isalpha() else "hex" if _IS_HEX.fullmatch(candidate) else "alnum" if _IS_ALNUM.fullmatch(candidate) else "base64"
    limit = LIMITS[kind] * math.log2(size) / math.log2(WINDOW) - 1e-9
    counts = dict.fromkeys(candidate, 0)
    total = 0.0
    for i, c in enumerate(candidate):
        total += _LOG[counts[c] + 1] - _LOG[counts[c]]
        counts[c] += 1
        if i >= size:
            gone = candidate[i - size]
            total += _LOG[counts[gone] - 1] - _LOG[counts[gone]]
            counts[gone] -= 1
        start = i - size + 1
        if start >= 0 and bits[start] > SURPRISE and math.log2(size) - total / size >= limit:
            return True
    return False


#: Characters of the longest candidate whose verdict is remembered.
REMEMBERED = 64


def _judged(candidate: str) -> bool:
    if allowed(candidate):
        return False
    return bool(not _WORDS.fullmatch(candidate) and window_spans(candidate) or surprising(candidate))


_remembered = functools.lru_cache(1 << 16)(_judged)


def is_secret(candidate: str) -> bool:
    """Does any window of the candidate count?  Words come again and again, so verdicts on short ones are remembered."""
    return _remembered(candidate) if len(candidate) <= REMEMBERED else _judged(candidate)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of entropy spans that no base span (sorted) holds."""
    out, at, reach = [], 0, 0  # reach: the furthest end of the base spans that begin no later than the candidate
    for m in _CANDIDATE.finditer(text):
        date = _DATE.match(text, m.start(), m.end())
        start, end = date.end() if date else m.start(), m.end()
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        if end - start >= LEAST and end > reach and is_secret(text[start:end]):
            out.append((start, 3, end))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: Rows whose texts are held as Python strings at once.
SLICE_ROWS = 500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        counts, sha, spans = [[], [], [], []], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            all_spans = sorted(base + entropy_spans(text, base))
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in all_spans))
            sha.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            spans.append(_listed(all_spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) per row of ``docs(doc_id, text, ...)``.

    spans: kind:start:end by start, then kind, comma-joined; code points, end exclusive.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return docs.select(*columns).mapInArrow(_scan_batches, schema)


def mask(text: str) -> str:
    """The text with each secret replaced by ``MASK``; overlapping spans are one.

    An assignment keeps its name: only its value is replaced.
    """
    spans = base_spans(text)
    spans += entropy_spans(text, spans)
    cuts = []
    for s, k, e in sorted(spans):
        if k == 0:
            s = _ASSIGN.match(text, s).start(1)
        cuts.append((s, e))
    out, at = [], 0
    for s, e in sorted(cuts):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:]


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        at = batch.schema.get_field_index("text")
        texts = [None if x is None else mask(x) for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of its texts replaced; null texts stay null, other columns are kept."""
    return docs.mapInArrow(_mask_batches, docs.schema)
