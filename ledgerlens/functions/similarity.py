"""Name similarity (NAM-2, NAM-3).

``token_sort_ratio`` follows the public token-sort ratio the rule book uses:
drop code points 128-255, turn non-word characters into spaces, lower-case,
strip, sort the tokens; then the indel similarity ``2 * LCS / (len1 + len2)``
as a 0-100 integer rounded half-to-even.  Equal processed strings score 100,
an empty one 0.  Names are normalised first (NAM-1); an empty normalised
name scores 0.

The LCS is Hyyro's bit-parallel algorithm on Python integers, one
addition/subtraction per character of the shorter string.  In Spark the score
is a pandas UDF applied to candidate pairs only (see
``operators.entity_resolution``), never to all pairs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python workers may not have this package on their path (the driver can run
# from any folder), so functions of this module travel to them by value.
import sys as _sys  # noqa: E402
from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

_LATIN1_HIGH = dict.fromkeys(range(128, 256))
_NON_WORD = re.compile(r"(?ui)\W")


def process(text: str) -> str:
    """Token-sort preprocessing of one string."""
    s = _NON_WORD.sub(" ", text.translate(_LATIN1_HIGH)).lower().strip()
    return " ".join(sorted(s.split())).strip()


def lcs_length(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> int:
    """0-100 indel similarity of two processed strings."""
    if a == b:
        return 100
    if not a or not b:
        return 0
    return int(round(100 * (2 * lcs_length(a, b)) / (len(a) + len(b))))


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(process(a), process(b))


def score_normalized(norm_a: str | None, norm_b: str | None) -> int:
    """NAM-2 on already normalised names."""
    if not norm_a or not norm_b:
        return 0
    return token_sort_ratio(norm_a, norm_b)


def processed(c: Column) -> Column:
    """``process`` of a column, in built-in functions."""
    word = F.regexp_replace(F.translate(c, "".join(map(chr, range(128, 256))), ""), r"(?U)[^\p{L}\p{N}_]", " ")
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(word), " "), lambda t: t != "")), " ")
