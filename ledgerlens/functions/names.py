"""Entity-name column functions (NAM-1).

Semantics: NULL or empty -> ""; strip; remove each business suffix in list
order when the (lower-cased) name ends with it, stripping after every cut;
drop characters that are neither word characters nor whitespace; collapse
whitespace; strip.  Case is kept (``case_insensitive`` lower-cases instead).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, AuditRules

# Whitespace as the audited rule book sees it (``str.isspace``): derived by
# rule, 29 code points including the four information separators.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())
_WS_CLASS = r"\s\x1c-\x1f"
_ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
# ASCII characters that are neither word characters nor white space
_ASCII_DROPPED = r"[!-/:-@\[-^`{-~\x00-\x08\x0e-\x1b\x7f]+"
# what neither the character filter nor the whitespace collapse changes
_PLAIN = r"^[A-Za-z0-9_]+( [A-Za-z0-9_]+)*\z"


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace as ``str.strip()`` does (``trim`` only strips spaces)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def _visible_ends(c: Column) -> Column:
    return F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)


def strip_column(c: Column) -> Column:
    """``py_strip`` of a column of a large table.

    Most texts begin and end with a visible ASCII character, which two numbers show; searching
    both ends in the list of white space costs more.  ``c`` is named several times, so it is no
    expression that takes time.
    """
    return F.when(_visible_ends(c), c).otherwise(py_strip(c))


def normalize_name(c: Column | str, rules: AuditRules = DEFAULT_RULES, null_as: str = "") -> Column:
    """Normalised entity name; ``null_as`` is the text a NULL name turns into
    before normalising ("" for vendors, "nan" for employees).

    ASCII names need no lambda.  For others the ordered suffix pass is one ``aggregate``,
    so the running value is named once per step and the expression stays small; it uses
    ``endswith``/``substring``/``btrim`` instead of a regular expression per
    suffix.  It runs over the few suffixes that the name holds anywhere: what is
    left after a cut is a beginning of the name, so it ends with no other one.
    Only the character filter and the whitespace collapse are regular expressions, which
    ASCII words with single spaces do without.
    """
    col = F.col(c) if isinstance(c, str) else c
    raw = F.coalesce(col.cast("string"), F.lit(null_as))
    ascii_only = F.octet_length(raw) == F.length(raw)
    x = F.when(ascii_only & _visible_ends(raw), _normalize_ascii(raw, rules)).otherwise(_normalize_any(raw, rules))
    if rules.name_case_insensitive:
        x = F.lower(x)
    # never NULL; saying so lets Catalyst drop the inferred IS NOT NULL filter
    # it would otherwise push below the projection and evaluate a second time
    return F.coalesce(x, F.lit(""))


def _normalize_ascii(name: Column, rules: AuditRules) -> Column:
    """Of ASCII characters, without white space at the ends: no lambda, which Spark would interpret.

    Read from its end, a name begins with the suffixes that are cut, in list order: each is
    taken if it is there, with the white space before it, and never given back.  Case folds as ``lower``
    does here; a suffix that is not lower-case ASCII ends no lower-cased name of this kind.
    """
    endings = [re.escape(s[::-1]) for s in rules.name_suffixes if s and s.isascii() and s == s.lower()]
    x = name
    if endings:
        cuts = "".join(f"(?:{e}[{_WS_CLASS}]*+)?+" for e in endings)
        x = F.reverse(F.regexp_replace(F.reverse(x), rf"(?i)\A{cuts}", ""))
    x = F.regexp_replace(x, _ASCII_DROPPED, "")
    return F.trim(F.regexp_replace(x, r"[\t-\r\x1c-\x1f][\s\x1c-\x1f]*| [\s\x1c-\x1f]+", " "))


def _normalize_any(name: Column, rules: AuditRules) -> Column:
    x = py_strip(name)
    suffixes = F.array(*[F.lit(s) for s in rules.name_suffixes])

    def cut(acc: Column, suffix: Column) -> Column:
        rest = py_strip(F.substring(acc, F.lit(1), F.length(acc) - F.length(suffix)))
        return F.when(F.endswith(F.lower(acc), suffix), rest).otherwise(acc)

    # a transform of a one-element array computes its element once, however often the lambda names it
    held = lambda name: F.transform(F.array(F.lower(name)), lambda low: F.filter(suffixes, lambda k: F.contains(low, k)))[0]
    x = F.transform(F.array(x), lambda name: F.aggregate(held(name), name, cut))[0]
    x = F.translate(x, _ASCII_MARKS, "")
    cleaned = F.regexp_replace(x, rf"(?U)[^\p{{L}}\p{{N}}_{_WS_CLASS}]", "")
    cleaned = py_strip(F.regexp_replace(cleaned, rf"(?U)[{_WS_CLASS}]+", " "))
    return F.when(x.rlike(_PLAIN), x).otherwise(cleaned)


def py_str(c: Column) -> Column:
    """Text of a value the way the rule book prints it: NULL becomes 'nan'."""
    return F.coalesce(c.cast("string"), F.lit("nan"))
