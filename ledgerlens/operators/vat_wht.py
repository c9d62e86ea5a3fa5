"""VAT / WHT deduction and remittance (VAT-1..6).

One scan of AP: each payment row is joined (left, broadcast) to a per-month
table of remitted flags and multiplied by the numbers of its rules, at most two,
so AP is read once for all four rules.  Columns of a finding follow from its rule
after that, so that a rollup computes only what it adds.
The remitted table is keyed by month and VAT/WHT only, so its size
is bounded by the calendar (12 rows a year), which makes the broadcast safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, AuditRules, as_datetime
from ..functions.dates import day_of, days_floor, lit_ts, month_text
from ..functions.names import py_str, py_strip
from ..functions.tax import late_penalty, should_have_vat, tier, vat_on, wht_category, wht_rate
from ..functions.text import described, naira
from .prepare import MONEY, ap_date_column, empty, has, money, row_order, timestamp

VAT_SCHEMA = T.StructType([
    T.StructField("issue_type", T.StringType()),
    T.StructField("vendor_name", T.StringType()),
    T.StructField("payment_amount", MONEY),
    T.StructField("expected_tax", T.DecimalType(20, 2)),
    T.StructField("remittance_status", T.StringType()),
    T.StructField("estimated_liability", T.DecimalType(20, 2)),
    T.StructField("period", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("row_id", T.StringType()),
])

PERIOD_PATTERN = r"^(19|20)[0-9]{2}-(0[1-9]|1[0-2])$"   # 2,424 months at most


def remitted_periods(tax: DataFrame | None, require_remittance_date: bool = True) -> DataFrame | None:
    """VAT-1 / TXF-3: distinct (upper(strip(tax_type)), strip(period_covered)) with
    both non-blank and the period not missing.  None if the columns are absent."""
    needed = ("tax_type", "period_covered") + (("remittance_date",) if require_remittance_date else ())
    if not has(tax, *needed):
        return None
    t = tax.select(F.upper(py_strip(py_str(F.col("tax_type")))).alias("tax_type"),
                   py_strip(py_str(F.col("period_covered"))).alias("period"))
    return t.where((F.col("tax_type") != "") & (F.col("period") != "") & (F.col("period") != "nan")).distinct()


def _month_number(year: Column, month: Column) -> Column:
    return year.cast("int") * 12 + month.cast("int")


def _period_flags(tax: DataFrame | None) -> DataFrame | None:
    periods = remitted_periods(tax)
    if periods is None:
        return None
    bounded = periods.where(F.col("tax_type").isin("VAT", "WHT") & F.col("period").rlike(PERIOD_PATTERN))
    flags = bounded.groupBy(_month_number(F.substring("period", 1, 4), F.substring("period", 6, 2)).alias("_month")).agg(
        F.max(F.col("tax_type") == "VAT").alias("_vat_ok"),
        F.max(F.col("tax_type") == "WHT").alias("_wht_ok"))
    return F.broadcast(flags)


def _by_rule(values: dict[int, Column]) -> Column:
    """The value of the finding's own rule; what no query reads is not computed."""
    out = F
    for rule, value in values.items():
        out = out.when(F.col("_rule") == rule, value)
    return out


def detect_vat_wht_issues(ap: DataFrame | None, tax: DataFrame | None = None, *, asof,
                          rules: AuditRules = DEFAULT_RULES, include: tuple[str, ...] | None = None,
                          sort: bool = False, texts: bool = True) -> DataFrame | None:
    """VAT-2..6 at evaluation instant ``asof``.  A NULL amount, VAT or WHT value
    raises no finding for that tax.  ``texts=False``: ``details`` is NULL."""
    if ap is None:
        return None
    dcol = ap_date_column(ap)
    if dcol is None or "amount" not in ap.columns:
        return empty(ap.sparkSession, VAT_SCHEMA)
    as_of = as_datetime(asof)
    zero = F.lit(0).cast(MONEY)
    base = ap.select(
        row_order(ap).alias("_rid"),
        (F.col("vendor_name").cast("string") if "vendor_name" in ap.columns else F.lit("Unknown")).alias("_vendor"),
        timestamp(ap, dcol, rules).alias("_ts"),
        money(ap, "amount").alias("_amt"),
        (F.lower(py_str(F.col("expense_category"))) if "expense_category" in ap.columns else F.lit("")).alias("_cat"),
        (money(ap, "vat_amount") if "vat_amount" in ap.columns else zero).alias("_vat"),
        (money(ap, "wht_amount") if "wht_amount" in ap.columns else zero).alias("_wht"),
    ).where(F.col("_ts").isNotNull() & (F.col("_amt") > 0)).withColumn("_keyword", wht_category(F.col("_cat"), rules))
    base = base.withColumn("_wht_due", F.round(F.col("_amt") * wht_rate(F.col("_keyword"), rules), 2))

    flags = _period_flags(tax)
    if flags is None:
        base = base.withColumn("_vat_ok", F.lit(False)).withColumn("_wht_ok", F.lit(False))
    else:
        base = (base.join(flags, _month_number(F.year(day_of(F.col("_ts"))), F.month(day_of(F.col("_ts")))) == flags["_month"], "left").drop("_month")
                .withColumn("_vat_ok", F.coalesce("_vat_ok", F.lit(False)))
                .withColumn("_wht_ok", F.coalesce("_wht_ok", F.lit(False))))

    amt, vat, wht, expected_wht = F.col("_amt"), F.col("_vat"), F.col("_wht"), F.col("_wht_due")
    on = (lambda r: include is None or r in include)
    needs_vat = should_have_vat(amt, rules)
    vat_rule = F.when(needs_vat & (vat == 0) & F.lit(on("VAT-2")), 2).when(needs_vat & (vat > 0) & ~F.col("_vat_ok") & F.lit(on("VAT-3")), 3)
    wht_rule = F.when((expected_wht > 0) & (wht == 0) & F.lit(on("VAT-4")), 4).when((wht > 0) & ~F.col("_wht_ok") & F.lit(on("VAT-5")), 5)
    found = base.select("*", F.explode(F.array(vat_rule, wht_rule)).alias("_rule")).where(F.col("_rule").isNotNull())

    expected_vat = vat_on(amt, rules)
    days = days_floor(F.col("_ts"), lit_ts(as_of))
    vat_penalty = F.when(days > rules.vat_penalty_grace_days, late_penalty(F.lit("VAT"), days, rules)).otherwise(0)
    wht_penalty = late_penalty(F.lit("WHT"), F.lit(0), rules)
    period = month_text(F.col("_ts"))
    liability = {2: expected_vat, 3: vat + vat_penalty, 4: expected_wht, 5: wht + wht_penalty}
    unremitted = [(rules.unremitted_high, "High")]
    details = {
        2: F.format_string("VAT of %s should have been deducted on payment of %s to %s",
                           naira(expected_vat), naira(amt), py_str(F.col("_vendor"))),
        3: F.format_string("VAT of %s was deducted but not remitted to FIRS for period %s. Estimated penalty: %s",
                           naira(vat), period, naira(vat_penalty)),
        4: F.format_string("WHT of %s should have been deducted on payment of %s to %s (category: %s)",
                           naira(expected_wht), naira(amt), py_str(F.col("_vendor")), F.col("_keyword")),
        5: F.format_string("WHT of %s was deducted but not remitted to FIRS for period %s. Penalty: %s",
                           naira(wht), period, naira(wht_penalty))}
    found = found.select(
        _by_rule({2: F.lit("VAT Under-deducted"), 3: F.lit("VAT Unremitted"), 4: F.lit("WHT Under-deducted"), 5: F.lit("WHT Unremitted")}).alias("issue_type"),
        F.col("_vendor").alias("vendor_name"), amt.alias("payment_amount"),
        _by_rule({2: expected_vat, 3: vat, 4: expected_wht, 5: wht}).cast("decimal(20,2)").alias("expected_tax"),
        F.when(F.col("_rule").isin(2, 4), F.lit("Not deducted")).otherwise(F.lit("Deducted but not remitted")).alias("remittance_status"),
        _by_rule({k: c.cast("decimal(20,2)") for k, c in liability.items()}).alias("estimated_liability"), period.alias("period"),
        _by_rule({2: tier(liability[2], [(rules.vat_high, "High"), (rules.vat_medium, "Medium")], "Low"),
                  3: tier(liability[3], unremitted, "Medium"), 4: tier(liability[4], [(rules.wht_medium, "Medium")], "Low"),
                  5: tier(liability[5], unremitted, "Medium")}).alias("risk_level"),
        described(texts, _by_rule(details)).alias("details"),
        F.concat(F.lit("VAT-"), F.col("_rule").cast("string")).alias("rule_id"), F.col("_rid").alias("row_id"))
    if sort:
        # a global sort samples its input with a separate job; behind a hash
        # exchange that job reads the findings' shuffle files instead of
        # re-running the whole payments scan
        found = (found.repartition("row_id")
                 .orderBy(F.col("estimated_liability").desc(), "row_id", "rule_id"))
    return found
