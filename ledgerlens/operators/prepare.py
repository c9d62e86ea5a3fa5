"""Per-table preparation shared by the detectors.

Every detector reads the caller's contract tables and derives what it needs
here: the evaluation date column (chosen per table), decimal money, the
normalised name and a row-order key that stands in for pandas row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, AuditRules
from ..functions.dates import coerce_timestamp

MONEY = T.DecimalType(18, 2)
# what an amount written as text may hold besides its number
MONEY_MARKS = "[\\s\u00a0\u20a6$\u20ac\u00a3]|NGN"
# a number with a decimal point, or a decimal comma; the other mark only where it groups thousands
POINT_NUMBER = r"^(?=.*\d)[+-]?(\d*|\d{1,3}(,\d{3})+)(\.\d*)?([eE][+-]?\d+)?$"
COMMA_NUMBER = r"^(?=.*\d)[+-]?(\d*|\d{1,3}(\.\d{3})+)(,\d*)?$"


def has(df: DataFrame | None, *cols: str) -> bool:
    return df is not None and all(c in df.columns for c in cols)


def ap_date_column(df: DataFrame) -> str | None:
    """``payment_date`` if the table has it, else ``transaction_date`` (per table, not per row)."""
    if "payment_date" in df.columns:
        return "payment_date"
    if "transaction_date" in df.columns:
        return "transaction_date"
    return None


def number_text(c: Column) -> Column:
    """Text without currency signs and white space."""
    return F.regexp_replace(c, MONEY_MARKS, "")


def money(df: DataFrame, name: str, rules: AuditRules = DEFAULT_RULES) -> Column:
    """Column ``name`` as DECIMAL(18,2); NaN and text that is no number become NULL.

    Text has a decimal point, or a decimal comma if ``rules.column_marks`` says so
    of the column; ``12,50`` under a decimal point is no number, and not 1250.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    elif isinstance(dtype, T.StringType):
        text = number_text(c)
        if dict(rules.column_marks).get(name) == "comma":
            c = F.when(text.rlike(COMMA_NUMBER), F.translate(text, ",.", "."))
        else:
            c = F.when(text.rlike(POINT_NUMBER), F.replace(text, F.lit(","), F.lit("")))
    return c.try_cast(MONEY)


def timestamp(df: DataFrame, name: str, rules: AuditRules = DEFAULT_RULES) -> Column:
    return coerce_timestamp(df, name, rules)


def row_order(df: DataFrame) -> Column:
    """Row-order key: ``row_id`` in its own type (numbers order as numbers).

    A table without one has no row order; a hash of the row stands in, which is
    enough to pick one of several rows.  Pairs of rows need ``numbered_copies``.
    """
    if "row_id" in df.columns:
        return F.col("row_id")
    return F.format_string("%016x", row_hash(df))


def row_hash(df: DataFrame) -> Column:
    """A number of a whole row, nulls left out."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def null_hash(df: DataFrame) -> Column:
    """A number of which columns of a row are null, which ``row_hash`` does not tell."""
    return F.xxhash64(*[F.col(c).isNull() for c in df.columns])


def order_text(df: DataFrame) -> Column:
    """``row_order`` as text that sorts alike, for unions of tables whose ids differ in type."""
    if "row_id" in df.columns and isinstance(df.schema["row_id"].dataType, T.IntegralType):
        shifted = F.col("row_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        return F.lpad(shifted.cast("string"), 20, "0")
    return row_order(df).cast("string")


def numbered_copies(df: DataFrame, rid: str) -> DataFrame:
    """``df`` with the hash ``rid`` made an id: equal rows are counted and numbered, so each copy has one of its own."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    copied = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return copied.select(*[F.format_string("%016x-%d", rid, "_copy").alias(c) if c == rid else F.col(c) for c in df.columns])


def text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

