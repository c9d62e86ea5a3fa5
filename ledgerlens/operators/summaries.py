"""Per-family summaries (DUP-5, VAT-7, EXP-7, GH-6, TXF-7).

Each is a one-row global aggregate over the family's findings: counts and
sums are partial aggregates, and the "top" row is a ``min_by`` over the
family's sort key, so no findings are sorted or collected to produce it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money as fmt_money

SUMMARY_COLS = ["total_flagged", "total_amount", "count", "top_entity", "top_amount", "detail"]


def _summary(findings: DataFrame, amount: str, entity: str, order: list[Column], detail_fmt: str,
             empty_detail: str, top_name: str) -> DataFrame:
    total = F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)")
    top = F.min_by(F.struct(F.col(entity).alias("e"), F.col(amount).alias("a")), F.struct(*order))
    agg = findings.agg(F.count(F.lit(1)).alias("n"), total.alias("total"), top.alias("top"))
    n = F.col("n")
    top_entity = F.when(n > 0, F.coalesce(F.col("top.e").cast("string"), F.lit("nan"))).otherwise(F.lit("N/A"))
    top_amount = F.when(n > 0, F.col("top.a")).otherwise(F.lit(0)).cast("decimal(38,2)")
    detail = F.when(n > 0, F.format_string(detail_fmt, n, top_entity, fmt_money(top_amount))) \
              .otherwise(F.lit(empty_detail))
    return agg.select(n.alias("total_flagged"), F.col("total").alias("total_amount"), n.alias("count"),
                      top_entity.alias(top_name), top_amount.alias("top_amount"), detail.alias("detail"))


def duplicate_summary(dups: DataFrame) -> DataFrame:
    """DUP-5: every pair counts; the top row is the largest flagged amount."""
    return _summary(dups, "flagged_amount", "vendor_name",
                    [F.negative(F.col("flagged_amount")), F.col("row_id_1"), F.col("row_id_2")],
                    "%d duplicate payments found. Top: %s (NGN %s)", "No duplicate payments detected.",
                    "top_vendor")


def vat_summary(issues: DataFrame) -> DataFrame:
    """VAT-7."""
    return _summary(issues, "estimated_liability", "issue_type",
                    [F.negative(F.col("estimated_liability")), F.col("row_id"), F.col("rule_id")],
                    "%d VAT/WHT issues found. Top issue: %s (NGN %s)", "No VAT/WHT issues detected.",
                    "top_issue")


def expense_summary(expenses: DataFrame) -> DataFrame:
    """EXP-7."""
    return _summary(expenses, "transaction_amount", "category",
                    [F.negative(F.col("transaction_amount")), F.col("category"), F.col("date")],
                    "%d overstated expense categories. Top: %s (NGN %s)", "No overstated expenses detected.",
                    "top_category")


def ghost_summary(vendors: DataFrame | None, employees: DataFrame | None) -> DataFrame | None:
    """GH-6: vendors then employees; the "top" entity is the first row of that
    concatenation, so a vendor wins over a larger employee."""
    parts = []
    for src, df in ((0, vendors), (1, employees)):
        if df is not None:
            parts.append(df.select("name", "total_paid", "red_flag_reason", "bank_account",
                                   F.lit(src).alias("_src")))
    if not parts:
        return None
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = [F.col("_src"), F.negative(F.col("total_paid")), F.col("name").isNull(), F.col("name"),
             F.col("red_flag_reason"), F.col("bank_account").isNull(), F.col("bank_account")]
    return _summary(u, "total_paid", "name", order, "%d ghost entities detected. Top: %s (NGN %s)",
                    "No ghost vendors or employees detected", "top_entity")


def filing_summary(filing: DataFrame) -> DataFrame:
    """TXF-7: counts by status and the largest penalty."""
    agg = filing.agg(F.count(F.lit(1)).alias("n"),
                     F.coalesce(F.sum("estimated_penalty"), F.lit(0)).cast("bigint").alias("total"),
                     F.count_if(F.col("status") == "Missed").alias("missed"),
                     F.count_if(F.col("status") == "At Risk").alias("at_risk"),
                     F.coalesce(F.max("estimated_penalty"), F.lit(0)).cast("bigint").alias("top"))
    n = F.col("n")
    detail = F.when(n > 0, F.format_string("%d tax filing risks. Missed: %d, At risk: %d", n, F.col("missed"),
                                           F.col("at_risk"))) \
              .otherwise(F.lit("No tax filing risks detected. All filings are on time."))
    return agg.select(n.alias("total_flagged"), F.col("total").alias("total_amount"), n.alias("count"),
                      F.col("missed").alias("missed_count"), F.col("at_risk").alias("at_risk_count"),
                      F.col("top").alias("top_penalty"), detail.alias("detail"))
