"""Report rollups over a scan (RPT-2..5, RPT-7..11).

All of them start from the per-family one-row summaries, so they are tiny
plans over a handful of rows after the family aggregates; top-k lists use
``orderBy().limit(k)``, which Spark runs as a per-partition top-k.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, AuditRules
from ..fixed_values import FAMILIES, PREVIEW_ROWS, RECOMMENDED_ACTIONS, TOP_ACTIONS
from ..functions.text import clean_text, money
from .scan import FINDING_COLS, ScanResult, unified_findings

FAMILY_ORDER = {name: i for i, name in enumerate(FAMILIES)}


def family_totals(scan: ScanResult) -> DataFrame:
    """One row per family the scan ran: (ord, category, amount, items, detail)."""
    rows = None
    for name, summary in scan.summaries().items():
        r = summary.select(F.lit(FAMILY_ORDER[name]).alias("ord"), F.lit(name).alias("category"),
                           F.col("total_amount").cast("decimal(38,2)").alias("amount"),
                           F.col("count").cast("bigint").alias("items"), F.col("detail"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def leakage_by_category(scan: ScanResult, revenue=None) -> DataFrame:
    """RPT-2: family totals plus a 'Total' row (the exact sum of the families);
    ``pct_of_revenue`` only when ``revenue`` > 0.  The total comes from a rollup,
    so the families are computed once."""
    fam = family_totals(scan).select("ord", "category", "amount")
    rolled = (fam.rollup("ord", "category")
              .agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").alias("amount"),
                   F.grouping_id().alias("_g"))
              .where(F.col("_g").isin(0, 3)))
    out = rolled.select(F.when(F.col("_g") == 3, F.lit(len(FAMILIES))).otherwise(F.col("ord")).alias("ord"),
                        F.when(F.col("_g") == 3, F.lit("Total")).otherwise(F.col("category")).alias("category"),
                        "amount")
    if revenue is not None and Decimal(str(revenue)) > 0:
        pct = F.round(F.col("amount").cast("double") / F.lit(float(revenue)) * 100, 1)
    else:
        pct = F.lit(None).cast("double")
    return out.withColumn("pct_of_revenue", pct)


def _severity(amount, rules: AuditRules):
    return (F.when(amount >= rules.severity_critical, "CRITICAL").when(amount >= rules.severity_high, "HIGH")
            .when(amount > 0, "MEDIUM").otherwise("CLEAN"))


def _short_label(amount):
    a = amount.cast("double")
    no_group = lambda x, d: F.regexp_replace(F.format_number(x, d), ",", "")
    return (F.when(a >= 1_000_000, F.concat(no_group(a / 1_000_000, 1), F.lit("M")))
            .when(a >= 1000, F.concat(no_group(a / 1000, 0), F.lit("K"))).otherwise(F.lit("0")))


def category_metrics(scan: ScanResult, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """RPT-3: count, severity tier, card tier and short amount label per family."""
    f = family_totals(scan)
    a = F.col("amount")
    card = F.when(a >= rules.severity_critical, "danger").when(a >= rules.severity_high, "warning") \
            .otherwise("success")
    return f.select("ord", "category", "amount", "items", _severity(a, rules).alias("severity"),
                    card.alias("card"), _short_label(a).alias("label"))


def leakage_breakdown(scan: ScanResult) -> DataFrame:
    """RPT-4: families with a positive amount, their share of the total, ranked."""
    f = family_totals(scan).where(F.col("amount") > 0)
    w_all = Window.partitionBy()
    w_rank = Window.orderBy(F.col("amount").desc(), F.col("ord"))
    total = F.sum("amount").over(w_all)
    return f.select("category", "amount",
                    F.round(F.col("amount").cast("double") / total.cast("double") * 100, 1).alias("share_pct"),
                    F.row_number().over(w_rank).cast("bigint").alias("rank"))


def findings_summary(scan: ScanResult, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """RPT-5: Category, Amount, Items Flagged, Details, Expected Recovery."""
    f = family_totals(scan)
    return f.select("ord", "category", "amount", F.col("items").alias("items_flagged"),
                    F.col("detail").alias("details"),
                    (F.col("amount") * F.lit(rules.recovery_rate)).cast("decimal(38,2)").alias("expected_recovery"))


GENERIC_ACTION = "Review all flagged transactions with your finance team"


def top_actions(scan: ScanResult, n: int = TOP_ACTIONS) -> DataFrame:
    """RPT-7: top two duplicates, top ghost vendor, top VAT/WHT issue, padded
    with a generic action and cut to ``n``."""
    spark = next(df.sparkSession for df in (scan.tax_filing, scan.duplicates, scan.ghost_employees) if df is not None)
    parts = []
    if scan.duplicates is not None:
        top2 = scan.duplicates.orderBy(F.col("flagged_amount").desc(), "row_id_1", "row_id_2").limit(2)
        d = top2.select(F.format_string("Recover duplicate payment to %s - Invoice %s", F.col("vendor_name"),
                                        F.col("invoice_ref")).alias("action"),
                        F.col("flagged_amount").cast("decimal(38,2)").alias("amount"), F.lit(1).alias("_grp"),
                        F.row_number().over(Window.orderBy(F.col("flagged_amount").desc(), "row_id_1", "row_id_2"))
                        .cast("decimal(38,2)").alias("_k"))
        parts.append(d)
    if scan.ghost_vendors is not None:
        g = (scan.ghost_vendors.orderBy(F.col("total_paid").desc(), F.col("name").asc_nulls_last(),
                                        "red_flag_reason", F.col("bank_account").asc_nulls_last()).limit(1)
             .select(F.format_string("Investigate ghost vendor: %s - %s", F.col("name"),
                                     F.col("red_flag_reason")).alias("action"),
                     F.col("total_paid").cast("decimal(38,2)").alias("amount"), F.lit(2).alias("_grp"),
                     F.lit(0).cast("decimal(38,2)").alias("_k")))
        parts.append(g)
    if scan.vat_wht is not None:
        v = (scan.vat_wht.orderBy(F.col("estimated_liability").desc(), "row_id", "rule_id").limit(1)
             .select(F.format_string("Remit unremitted %s for %s", F.col("issue_type"),
                                     F.col("vendor_name")).alias("action"),
                     F.col("estimated_liability").cast("decimal(38,2)").alias("amount"), F.lit(3).alias("_grp"),
                     F.lit(0).cast("decimal(38,2)").alias("_k")))
        parts.append(v)
    pad = spark.range(1, n + 1).select(F.lit(GENERIC_ACTION).alias("action"),
                                       F.lit(0).cast("decimal(38,2)").alias("amount"),
                                       F.lit(4).alias("_grp"), F.col("id").cast("decimal(38,2)").alias("_k"))
    u = pad
    for p in parts:
        u = p.unionByName(u)
    ranked = u.orderBy("_grp", "_k").limit(n)
    return ranked.select(F.row_number().over(Window.orderBy("_grp", "_k")).cast("bigint").alias("rank"),
                         "action", "amount")


def recommended_actions(scan: ScanResult, rules: AuditRules = DEFAULT_RULES,
                        n: int = RECOMMENDED_ACTIONS) -> DataFrame:
    """RPT-8: families with a positive amount by priority (1: >= 1M, 2: >= 100k,
    3: else), family order within a priority, first ``n``.  Each action names
    its own family's count."""
    f = family_totals(scan).where(F.col("amount") > 0)
    a = F.col("amount")
    prio = F.when(a >= rules.severity_critical, 1).when(a >= rules.severity_high, 2).otherwise(3)
    out = f.select("ord", "category", prio.alias("priority"),
                   F.format_string("Review and recover %d flagged %s items", F.col("items"),
                                   F.lower(F.col("category"))).alias("action"),
                   a.alias("amount"), (a * F.lit(rules.recovery_rate)).cast("decimal(38,2)").alias("recovery"))
    label = F.when(F.col("priority") == 1, "URGENT").when(F.col("priority") == 2, "HIGH").otherwise("MEDIUM")
    return out.withColumn("priority_label", label).orderBy("priority", "ord").limit(n)


def findings_preview(scan: ScanResult, n: int = PREVIEW_ROWS) -> DataFrame:
    """RPT-9: the first ``n`` findings of every family in its report order."""
    u = unified_findings(scan)
    first = F.when(F.col("category") == "Tax Risk", F.col("sub_category")).otherwise(F.lit(""))
    w = Window.partitionBy("category", "_part").orderBy(first, F.col("amount").desc(), F.col("finding_id"))
    part = F.when(F.col("category") == "Ghost", F.split("finding_id", r"\|").getItem(0)).otherwise(F.lit(""))
    return (u.withColumn("_part", part).withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= n).drop("_part"))


def narrative(scan: ScanResult, company: str = "the company", period: str = "the current period",
              rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """RPT-10: the summary paragraph as numbered lines, built in one pass over
    the family totals (at most five rows, so the unpartitioned windows are tiny)."""
    everything = Window.partitionBy()
    by_amount = Window.orderBy(F.col("amount").desc(), "ord")
    f = (family_totals(scan)
         .withColumn("_total", F.sum("amount").over(everything).cast("decimal(38,2)"))
         .withColumn("_items", F.sum("items").over(everything))
         .withColumn("_first", F.col("ord") == F.min("ord").over(everything))
         .withColumn("_r", F.row_number().over(by_amount)))
    total, positive, first = F.col("_total"), F.col("amount") > 0, F.col("_first")

    def line(cond, no, text):
        return F.when(cond, F.struct(F.lit(no).cast("bigint").alias("line"), text.alias("text")))

    head = F.when(total > 0, F.format_string(
        f"This audit of {company} for {period} identified total financial leakage of NGN %s across %d flagged items.",
        money(total), F.col("_items"))).otherwise(F.lit(
            f"This audit of {company} for {period} found no significant financial leakage. "
            "All 5 detection engines returned clean results."))
    share = F.format_number(F.col("amount").cast("double") / total.cast("double") * 100, 1)
    lines = [
        line(first, 1, head),
        line(first & (total > 0), 2, F.lit("Breakdown by category:")),
        F.when(positive, F.struct((F.col("_r") + 2).cast("bigint").alias("line"),
                                  F.format_string("- %s: NGN %s (%s%%)", F.col("category"), money(F.col("amount")),
                                                  share).alias("text"))),
        line(positive & (F.col("_r") == 1), 100, F.format_string(
            "The most significant area of concern is %s, accounting for NGN %s. Immediate investigation and "
            "recovery action is recommended, starting with the highest-value findings.",
            F.col("category"), money(F.col("amount")))),
        line(first & (total > 0), 101, F.format_string(
            "Expected recovery potential: 80%% of identified leakage (NGN %s).",
            money((total * F.lit(rules.recovery_rate)).cast("decimal(38,2)")))),
    ]
    return f.select(F.inline(F.filter(F.array(*lines), lambda x: x.isNotNull())))


def clean_findings_text(scan: ScanResult) -> DataFrame:
    """RPT-11: unified findings with their ``details`` made latin-1 safe."""
    u = unified_findings(scan)
    return u.select(*[c for c in FINDING_COLS if c != "details"], clean_text(F.col("details")).alias("details"))
