"""Report text column functions (money formatting, RPT-11 ``clean_text``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CURRENCY_SIGN, TEXT_REPLACEMENTS


def money(x: Column) -> Column:
    """``1,234.56`` (two decimals, thousands separators)."""
    return F.format_number(x, 2)


def naira(x: Column) -> Column:
    return F.concat(F.lit(CURRENCY_SIGN), money(x))


def clean_text(c: Column) -> Column:
    """RPT-11: ASCII-safe replacements, then anything outside latin-1 becomes '?'."""
    x = F.coalesce(c.cast("string"), F.lit("None"))
    for src, dst in TEXT_REPLACEMENTS:
        x = F.replace(x, F.lit(src), F.lit(dst))
    return F.regexp_replace(x, r"[^\x{00}-\x{FF}]", "?")


def described(texts: bool, details: Column) -> Column:
    """A finding's sentence, or NULL where only its amounts are wanted."""
    return details if texts else F.lit(None).cast("string")
