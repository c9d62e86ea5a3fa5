"""Date and time column functions.

All instants are TIMESTAMP_NTZ (wall-clock, no zone), so results never depend
on the session time zone.  Whole-day differences follow the rule book:
``floor`` of the elapsed time for "days since", ``ceil`` for the gap between two
payments ordered by time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, AuditRules

DAY_MICROS = 86_400_000_000
ISO_DATE = r"^\d{4}-\d{1,2}(-\d{1,2}([T ].*)?)?$"


def _shape(fmt: str) -> str | None:
    """A pattern that all text matches which ``fmt`` can read, or None for formats of other parts than day, month and year.

    Trying a format on text of another shape costs an exception a value.
    """
    parts = {"yyyy": r"[+-]?\d{4,}", "MMM": r"[^\d]+", "MM": r"[+-]?\d+", "M": r"[+-]?\d+", "dd": r"[+-]?\d+", "d": r"[+-]?\d+"}
    tokens = re.findall(r"y+|M+|d+|[^yMd]+", fmt)
    if not all(t in parts or t in ("/", "-", ".", " ") for t in tokens) or any((a in parts) == (b in parts) for a, b in zip(tokens, tokens[1:])):
        return None
    return "^" + "".join(parts.get(t) or re.escape(t) for t in tokens)


def _try_date(text: Column, fmt: str) -> Column:
    shape, read = _shape(fmt), F.try_to_date(text, fmt)
    return read if shape is None else F.when(text.rlike(shape), read)


def coerce_timestamp(df: DataFrame, name: str, rules: AuditRules = DEFAULT_RULES) -> Column:
    """Column ``name`` as TIMESTAMP_NTZ; unparseable text becomes NULL (SRC-7).

    Text in ISO order is read as it stands, with or without time, fraction and
    zone (the wall clock counts).  Other spellings are dates, read by
    ``rules.column_formats[name]`` if the caller gives one format for the column,
    else by ``rules.date_formats``, which agree on the order of day and month.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    own = dict(rules.column_formats).get(name)
    formats = (own,) if own else rules.date_formats
    parsed = [_try_date(text, fmt).cast("timestamp_ntz") for fmt in formats]
    iso = F.when(text.rlike(ISO_DATE), text.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *parsed)


def lit_ts(value) -> Column:
    """A wall-clock instant; built from text so no time zone is involved."""
    from ..config import as_datetime
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def micros_of_day(ts: Column) -> Column:
    seconds = F.date_part(F.lit("SECOND"), ts)          # seconds with the fraction
    return (F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000
            + (seconds * 1_000_000).cast("bigint"))


def day_of(ts: Column) -> Column:
    """The DATE of a TIMESTAMP_NTZ, as its cast gives it, by division of its seconds: the cast makes
    a calendar object a row.  Seconds are cut towards 1970, so a day may be one too late before it."""
    day = F.date_from_unix_date(F.floor(F.unix_timestamp(ts) / 86_400).cast("int"))
    return F.when(day.cast("timestamp_ntz") <= ts, day).otherwise(F.date_sub(day, 1))


def epoch_micros(ts: Column) -> Column:
    """Wall-clock microseconds since 1970; only instants within a day have their parts read."""
    day = day_of(ts)
    return (F.unix_date(day).cast("bigint") * DAY_MICROS
            + F.when(day.cast("timestamp_ntz") == ts, F.lit(0).cast("bigint")).otherwise(micros_of_day(ts)))


def micros_between(start: Column, end: Column) -> Column:
    """Elapsed wall-clock microseconds; calendar arithmetic only, so the result
    does not depend on the session time zone (no daylight-saving hour)."""
    return epoch_micros(end) - epoch_micros(start)


def days_floor(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, floored (negative gaps round down)."""
    return F.floor(micros_between(start, end) / F.lit(float(DAY_MICROS))).cast("bigint")


def month_start(ts: Column) -> Column:
    """First day of the month as DATE."""
    return F.trunc(day_of(ts), "MM")


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")

