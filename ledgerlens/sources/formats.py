"""Number and date spellings of a text table, by vote (SRC-7).

One aggregate pass counts, per money and date column, the values that can be read
in one way only and those that can be read in both: ``1,234.56`` needs a decimal
point and ``12,50`` a decimal comma, ``1,234`` may have either; ``31/01/2026`` has
the day first and ``01/31/2026`` the month, ``02/03/2026`` may have either.  A
column gets a spelling if there are votes for it and none against it; else its
outcome is ``ambiguous`` (votes for both, or only values that go both ways) or
``none`` (nothing to tell).  Nothing is decided by a value's first appearance.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditRules
from ..operators.prepare import COMMA_NUMBER, POINT_NUMBER, number_text

AMBIGUOUS, NONE = "ambiguous", "none"
DAY_FIRST, MONTH_FIRST = "day first", "month first"
_PARTS = r"^\s*(\d{1,2})([/.-])(\d{1,2})\2(\d{4})\s*$"


def _money_votes(c: Column) -> tuple[Column, Column, Column]:
    text = number_text(c)
    point, comma = text.rlike(POINT_NUMBER), text.rlike(COMMA_NUMBER)
    marked = text.rlike("[.,]")
    return point & ~comma, comma & ~point, point & comma & marked


def _date_votes(c: Column) -> tuple[Column, Column, Column]:
    first, second = (F.regexp_extract(c, _PARTS, i).try_cast("int") for i in (1, 3))
    day, month = first.between(1, 31) & second.between(1, 12), first.between(1, 12) & second.between(1, 31)
    return day & ~month, month & ~day, day & month & (first != second)


def column_formats(df: DataFrame, money_columns: list[str], date_columns: list[str]) -> DataFrame:
    """(column, kind, first_votes, second_votes, either, outcome) per text column.

    first and second: decimal point and decimal comma, or day first and month first;
    either: values that can be read both ways, differently.
    """
    rows = []
    kinds = [(c, "money", _money_votes, "point", "comma") for c in money_columns] + [(c, "date", _date_votes, DAY_FIRST, MONTH_FIRST) for c in date_columns]
    for name, kind, votes, one, two in kinds:
        first, second, either = (F.count_if(v) for v in votes(F.col(name).cast("string")))
        rows.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), first.alias("first_votes"), second.alias("second_votes"),
                             either.alias("either"), F.lit(one).alias("_one"), F.lit(two).alias("_two")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, kind string, first_votes bigint, second_votes bigint, either bigint, outcome string")
    counted = df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))
    a, b = F.col("first_votes"), F.col("second_votes")
    outcome = (F.when((a > 0) & (b == 0), F.col("_one")).when((b > 0) & (a == 0), F.col("_two"))
               .when((a > 0) | (F.col("either") > 0), F.lit(AMBIGUOUS)).otherwise(F.lit(NONE)))
    return counted.withColumn("outcome", outcome).drop("_one", "_two")


def with_formats(rules: AuditRules, formats: DataFrame) -> AuditRules:
    """``rules`` that read the columns as voted; the caller's own formats come first, others stay as they are."""
    marks, dates = dict(rules.column_marks), dict(rules.column_formats)
    for r in formats.collect():   # one row per column
        if r["kind"] == "money" and r["outcome"] in ("point", "comma"):
            marks.setdefault(r["column"], r["outcome"])
        elif r["outcome"] == MONTH_FIRST:
            dates.setdefault(r["column"], "M/d/yyyy")
    return replace(rules, column_marks=tuple(marks.items()), column_formats=tuple(dates.items()))

