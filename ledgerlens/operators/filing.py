"""Late tax filing risk (TXF-1..6).

The obligation grid is the set of observed months (a distinct month bucket
over the three tables; partial aggregation keeps it cheap) times the tax
types that apply, built with ``explode`` rather than a cross join.  Remitted
periods are restricted to the three filing types and 'YYYY-MM' keys, a
calendar-bounded table, then anti-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, AuditRules, as_datetime
from ..functions.dates import days_floor, lit_ts, month_start, month_text
from ..functions.tax import due_date, late_penalty, tier
from ..functions.text import naira
from .prepare import ap_date_column, empty, timestamp
from .vat_wht import PERIOD_PATTERN, remitted_periods

FILING_SCHEMA = T.StructType([
    T.StructField("tax_type", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("due_date", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("days_overdue", T.LongType()),
    T.StructField("estimated_penalty", T.LongType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("details", T.StringType()),
])
MISSED = "Missed"
AT_RISK = "At Risk"


def observed_months(ap: DataFrame | None, payroll: DataFrame | None, tax: DataFrame | None,
                    rules: AuditRules = DEFAULT_RULES) -> DataFrame | None:
    """TXF-1: distinct first-of-month DATEs seen in AP dates, payroll months and remittance dates."""
    parts = []
    if ap is not None and ap_date_column(ap) is not None:
        parts.append(ap.select(timestamp(ap, ap_date_column(ap), rules).alias("_ts")))
    if payroll is not None and "month" in payroll.columns:
        parts.append(payroll.select(timestamp(payroll, "month", rules).alias("_ts")))
    if tax is not None and "remittance_date" in tax.columns:
        parts.append(tax.select(timestamp(tax, "remittance_date", rules).alias("_ts")))
    if not parts:
        return None
    u = parts[0].select(month_start(F.col("_ts")).alias("month"))
    for p in parts[1:]:
        u = u.unionByName(p.select(month_start(F.col("_ts")).alias("month")))
    # the missing month is left out by another column than the key: a filter on the key would be
    # pushed to the rows below, where it computes their months once more
    months = u.groupBy("month").agg(F.max("month").alias("_own"))
    return months.where(F.col("_own").isNotNull()).select("month")


def obligations(months: DataFrame, ap: DataFrame | None, payroll: DataFrame | None,
                rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """TXF-2: (month, tax_type, due_date) for VAT and WHT when AP has rows and
    PAYE when payroll has rows; types without a deadline are skipped."""
    deadlines = {t: d for t, d in rules.filing_deadlines if d}
    wanted = []
    if ap is not None:
        wanted += [("VAT", ap), ("WHT", ap)]
    if payroll is not None:
        wanted += [("PAYE", payroll)]
    wanted = [(t, src) for t, src in wanted if t in deadlines]
    if not wanted:
        return months.select("month", F.lit(None).cast("string").alias("tax_type"),
                             F.lit(None).cast("date").alias("due_date")).limit(0)
    grid = months.withColumn("tax_type", F.explode(F.array(*[F.lit(t) for t, _ in wanted])))
    present = None
    for t, src in wanted:
        cond = (F.col("tax_type") == t) & src.exists()
        present = cond if present is None else present | cond
    day = F.lit(None).cast("int")
    for t, d in deadlines.items():
        day = F.when(F.col("tax_type") == t, F.lit(d)).otherwise(day)
    return grid.where(present).withColumn("due_date", due_date(F.col("month"), day))


def detect_tax_filing_risk(tax: DataFrame | None = None, payroll: DataFrame | None = None,
                           ap: DataFrame | None = None, *, asof, rules: AuditRules = DEFAULT_RULES,
                           sort: bool = False) -> DataFrame | None:
    """TXF-4..6 at evaluation instant ``asof``."""
    spark = next((d.sparkSession for d in (tax, payroll, ap) if d is not None), None)
    if spark is None:
        return None
    months = observed_months(ap, payroll, tax, rules)
    if months is None:
        return empty(spark, FILING_SCHEMA)
    grid = obligations(months, ap, payroll, rules).withColumn("period", month_text(F.col("month")))
    remitted = remitted_periods(tax, require_remittance_date=False)
    if remitted is not None:
        bounded = remitted.where(F.col("tax_type").isin("VAT", "WHT", "PAYE") & F.col("period").rlike(PERIOD_PATTERN))
        grid = grid.join(F.broadcast(bounded), ["tax_type", "period"], "left_anti")
    d = days_floor(F.col("due_date").cast("timestamp_ntz"), lit_ts(as_datetime(asof)))
    g = grid.withColumn("_d", d).where((F.col("_d") > 0) | (F.col("_d") > -rules.filing_at_risk_days))
    missed = F.col("_d") > 0
    penalty = late_penalty(F.col("tax_type"), F.col("_d"), rules)
    due_txt = F.date_format(F.col("due_date"), "yyyy-MM-dd")
    out = g.select(
        "tax_type", "period", due_txt.alias("due_date"),
        F.when(missed, F.lit(MISSED)).otherwise(F.lit(AT_RISK)).alias("status"),
        F.when(missed, F.col("_d")).otherwise(F.lit(0)).cast("bigint").alias("days_overdue"),
        F.when(missed, penalty).otherwise(F.lit(0)).cast("bigint").alias("estimated_penalty"),
        F.when(missed, tier(F.col("_d"), [(rules.filing_high_days, "High"), (rules.filing_medium_days, "Medium")],
                            "Low", strict=True)).otherwise(F.lit("Medium")).alias("risk_level"),
        F.when(missed, F.format_string("%s for %s was due on %s and is now %d days overdue. Estimated penalty: %s",
                                       F.col("tax_type"), F.col("period"), due_txt, F.col("_d"), naira(penalty)))
         .otherwise(F.format_string("%s for %s is due on %s — %d days remaining. File now to avoid penalties.",
                                    F.col("tax_type"), F.col("period"), due_txt, F.abs(F.col("_d")))).alias("details"),
    )
    if sort:
        out = out.orderBy(F.col("status").asc(), F.col("estimated_penalty").desc(), "tax_type", "period")
    return out
