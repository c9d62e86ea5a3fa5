"""Ingest (SRC-1, SRC-6..9): read CSV or Parquet, normalise headers, map
aliases, validate the contract and project typed columns.

CSV is read with every column as text and typed afterwards with ``try_``
casts, so a bad value becomes NULL instead of failing the job (plain casts
raise under ANSI mode); ``rejects`` counts such values.  Without a ``row_id``
column one is added that is unique per row; Spark reads files and splits in no
fixed order, so it says nothing about order.  A caller whose rows have an order
gives a ``row_id`` of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..config import DEFAULT_RULES, AuditRules
from ..fixed_values import CURRENCY_SIGN, EXPECTED_COLUMNS
from ..functions.dates import coerce_timestamp
from ..functions.text import money as fmt_money
from ..operators.prepare import COMMA_NUMBER, POINT_NUMBER, money, number_text
from ..tables import AuditTables
from .contracts import Validation, apply_mapping, auto_map_columns, normalize_columns, validate_columns
from .csv_splits import read_csv_splits
from .formats import column_formats, with_formats

DATE_COLUMNS = {"transaction_date", "payment_date", "month", "remittance_date", "date_added", "date_joined"}
MONEY_COLUMNS = {"amount", "vat_amount", "wht_amount", "gross_salary", "paye_amount", "pension_amount"}
VALIDATED = ("ap", "payroll", "tax_remittance")


#: Quotes inside quoted fields are doubled, as spreadsheets and data frames write them.
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool | str = True) -> DataFrame | None:
    """SRC-1: ``.csv`` -> header CSV (all text), ``.parquet`` -> Parquet.
    Unsupported suffixes raise; unreadable paths return None.

    ``multi_line``: True if quoted fields may hold line breaks; a file is then read as
    a whole by one task.  ``"splits"`` reads such files by many tasks (``csv_splits``,
    where quotes inside fields must be doubled).  False: no field holds a line break.
    """
    kind = fmt or ("csv" if path.lower().endswith(".csv") else
                   "parquet" if path.lower().endswith(".parquet") else None)
    if kind is None:
        raise ValueError(f"Unsupported file format: {path}. Please upload CSV or Parquet.")
    try:
        if kind == "csv" and multi_line == "splits":
            return read_csv_splits(spark, path, CSV_OPTIONS)
        if kind == "csv":
            return spark.read.options(**CSV_OPTIONS, header=True, inferSchema=False, multiLine=multi_line).csv(path)
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def coerce_types(df: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """SRC-7: contract dates -> TIMESTAMP_NTZ, money -> DECIMAL(18,2), the rest as is."""
    return df.select(*_typed(df, rules))


def _typed(df: DataFrame, rules: AuditRules) -> list[Column]:
    cols = []
    for c in df.columns:
        if c in DATE_COLUMNS:
            cols.append(coerce_timestamp(df, c, rules).alias(c))
        elif c in MONEY_COLUMNS:
            cols.append(money(df, c, rules).alias(c))
        else:
            cols.append(F.col(c))
    return cols


def rejects(df: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """(column, given, rejected): how many values a date or money column holds, and how many of them
    ``coerce_types`` can't read.  One pass over the table."""
    typed = [c for c in df.columns if c in DATE_COLUMNS | MONEY_COLUMNS]
    if not typed:
        return df.sparkSession.createDataFrame([], "column string, given bigint, rejected bigint")
    counts = []
    for c in typed:
        given = F.length(F.trim(F.col(c).cast("string"))) > 0
        read = coerce_timestamp(df, c, rules) if c in DATE_COLUMNS else money(df, c, rules)
        counts.append(F.struct(F.lit(c).alias("column"), F.count_if(given).alias("given"),
                               F.count_if(given & read.isNull()).alias("rejected")))
    return df.agg(F.array(*counts).alias("_c")).select(F.inline("_c"))


REJECTIONS = "_rejections"


def checked_types(df: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """``coerce_types`` with ``_rejections``: (column, raw, reason) of each value that is given but can't be read."""
    checked = [c for c in df.columns if c in DATE_COLUMNS | MONEY_COLUMNS]
    # each value is read once: what is given beside what was read
    read = df.select(*[t.alias(c) for c, t in zip(df.columns, _typed(df, rules))], *[F.col(c).cast("string").alias(f"_raw_{c}") for c in checked])
    found = []
    for c in checked:
        raw = F.col(f"_raw_{c}")
        reason = F.lit("not a date") if c in DATE_COLUMNS else F.when(number_text(raw).rlike(POINT_NUMBER) | number_text(raw).rlike(COMMA_NUMBER),
                                                                     F.lit("another decimal mark or too large")).otherwise(F.lit("not a number"))
        found.append(F.when(F.col(c).isNull() & (F.length(F.trim(raw)) > 0), F.struct(F.lit(c).alias("column"), raw.alias("raw"), reason.alias("reason"))))
    none = F.array().cast("array<struct<column:string,raw:string,reason:string>>")
    rejections = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else none
    return read.select(*df.columns, rejections.alias(REJECTIONS))


def quarantine(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected values), written under ``path`` in one pass over ``checked_types``.

    A row with a rejection is not accepted; it gives one row (row_id, column, raw,
    reason) per value that can't be read.  ``row_id`` must name a row.
    """
    rejected = F.size(REJECTIONS) > 0
    checked.withColumn("_rejected", rejected).write.mode("overwrite").partitionBy("_rejected").parquet(path)
    schema = checked.schema.add("_rejected", "boolean")
    back = checked.sparkSession.read.schema(schema).parquet(path)
    return back.where("not _rejected").drop(REJECTIONS, "_rejected"), rejected_values(back.where("_rejected"))


def rejected_values(checked: DataFrame) -> DataFrame:
    """(row_id, column, raw, reason) per rejected value."""
    return checked.select("row_id", F.explode(REJECTIONS).alias("x")).select("row_id", "x.column", "x.raw", "x.reason")


@dataclass(frozen=True)
class Loaded:
    table: DataFrame | None
    validation: Validation
    error: str | None = None
    rejects: DataFrame | None = None
    #: the typed table with ``_rejections``; see ``quarantine``
    checked: DataFrame | None = None
    #: how the columns of text are spelled, if it was asked for
    formats: DataFrame | None = None


def prepare_table(df: DataFrame, table_type: str, rules: AuditRules = DEFAULT_RULES,
                  add_row_id: bool = True, infer_formats: bool = False) -> Loaded:
    """SRC-6 on a DataFrame: normalise headers, map aliases, validate (masters are
    not validated), coerce types and add ``row_id`` if missing.  Deliberate fix:
    aliases are mapped before validation, so an aliased required column passes.

    ``infer_formats`` reads the table once to find the decimal mark and the order of
    dates of each column of text (``formats``); columns of which the vote is
    ambiguous are read as ``rules`` say."""
    df = normalize_columns(df)
    df = apply_mapping(df, auto_map_columns(df.columns, table_type))
    check = validate_columns(df.columns, table_type)
    if table_type in VALIDATED and not check.is_valid:
        return Loaded(None, check, f"missing columns: {', '.join(check.missing_required)}")
    if add_row_id and "row_id" not in df.columns:
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    formats = None
    if infer_formats:
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        formats = column_formats(df, [c for c in text if c in MONEY_COLUMNS], [c for c in text if c in DATE_COLUMNS])
        formats = df.sparkSession.createDataFrame(formats.collect(), formats.schema)   # one row per column: the table is not read again
        rules = with_formats(rules, formats)
    return Loaded(coerce_types(df, rules), check, rejects=rejects(df, rules), checked=checked_types(df, rules), formats=formats)


def load_table(spark: SparkSession, path: str, table_type: str, rules: AuditRules = DEFAULT_RULES,
               fmt: str | None = None, multi_line: bool | str = True, infer_formats: bool = False) -> Loaded:
    """SRC-6: read then prepare."""
    raw = read_table(spark, path, fmt, multi_line)
    if raw is None:
        return Loaded(None, validate_columns([], table_type), f"could not read {path}")
    return prepare_table(raw, table_type, rules, infer_formats=infer_formats)


def load_each(spark: SparkSession, paths: dict[str, str], rules: AuditRules = DEFAULT_RULES) -> dict[str, Loaded]:
    """What became of each of the five tables that has a path: table, validation, error and rejects."""
    return {t: load_table(spark, paths[t], t, rules) for t in EXPECTED_COLUMNS if t in paths}


def load_tables(spark: SparkSession, paths: dict[str, str], rules: AuditRules = DEFAULT_RULES,
                strict: bool = True) -> AuditTables:
    """The tables that have a path.  A table that can't be loaded raises ValueError with all errors;
    with ``strict=False`` it is left out, and ``load_each`` tells why."""
    loaded = load_each(spark, paths, rules)
    errors = [f"{t}: {x.error}" for t, x in loaded.items() if x.error]
    if strict and errors:
        raise ValueError("; ".join(errors))
    return AuditTables(**{t: x.table for t, x in loaded.items()})


def data_profile(df: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """SRC-8: one row with rows, columns, the date range of the first column whose
    name contains 'date' and has a parseable value, and the amount (else gross
    salary) total, in one pass."""
    date_cols = [c for c in df.columns if "date" in c.lower()]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(date_cols):
        ts = coerce_timestamp(df, c, rules)
        aggs += [F.min(ts).alias(f"_min{i}"), F.max(ts).alias(f"_max{i}")]
    amount_col = "amount" if "amount" in df.columns else "gross_salary" if "gross_salary" in df.columns else None
    if amount_col:
        aggs.append(F.coalesce(F.sum(money(df, amount_col, rules)), F.lit(0)).cast("decimal(38,2)").alias("_total"))
    a = df.agg(*aggs)
    lo = F.coalesce(*[F.col(f"_min{i}") for i in range(len(date_cols))]) if date_cols else F.lit(None)
    hi = F.coalesce(*[F.when(F.col(f"_min{i}").isNotNull(), F.col(f"_max{i}")) for i in range(len(date_cols))]) \
        if date_cols else F.lit(None)
    total = F.col("_total") if amount_col else F.lit(None).cast("decimal(38,2)")
    return a.select(
        F.col("rows"), F.lit(",".join(df.columns)).alias("columns"),
        F.date_format(lo, "yyyy-MM-dd").alias("date_from"), F.date_format(hi, "yyyy-MM-dd").alias("date_to"),
        total.alias("total_amount"),
        F.when(total.isNotNull(), F.concat(F.lit(CURRENCY_SIGN), fmt_money(total))).alias("total_amount_text"))


def record_counts(tables: AuditTables) -> DataFrame:
    """SRC-9: rows per loaded table, plus the total over AP, payroll and tax."""
    parts = []
    for name, df in tables.items():
        if df is not None:
            parts.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    total = u.where(F.col("table").isin(*VALIDATED)).agg(F.lit("total").alias("table"),
                                                          F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return u.unionByName(total)
