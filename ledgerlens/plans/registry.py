"""Registered queries: one per operator of the inventory, each reading the
fixture tables derived from ``sf_dir`` and returning a DataFrame whose column
names and types match its oracle statement (money as DOUBLE)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ghosts import detect_ghost_employees, detect_ghost_vendors
from ..sources.fixtures import FIXTURE_ASOF, fixture_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ASOF = FIXTURE_ASOF


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def boundary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Project ``cols`` (default: all public columns), decimals as DOUBLE."""
    keep = cols or [c for c in df.columns if not c.startswith("_")]
    out = []
    for c in keep:
        dtype = df.schema[c].dataType
        out.append(F.col(c).cast("double").alias(c) if isinstance(dtype, T.DecimalType) else F.col(c))
    return df.select(*out)


GHOST_COLS = ["name", "type", "bank_account", "red_flag_reason", "total_paid", "risk_level", "details", "rule_id"]


def _ghv(rules: tuple[str, ...] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixture_tables(spark, sf_dir)
        return boundary(detect_ghost_vendors(t.ap, t.vendor_master, include=rules), GHOST_COLS)
    return run


QUERIES["ghv1_not_in_vendor_master"] = _ghv(("GHV-1",))
QUERIES["ghv2_shared_vendor_bank"] = _ghv(("GHV-2",))
QUERIES["ghv3_single_large_payment"] = _ghv(("GHV-3",))
QUERIES["ghv4_created_and_paid"] = _ghv(("GHV-4",))
QUERIES["ghv5_ghost_vendors"] = _ghv(None)


def _ghe(rules: tuple[str, ...] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixture_tables(spark, sf_dir)
        return boundary(detect_ghost_employees(t.payroll, t.employee_master, include=rules), GHOST_COLS)
    return run


QUERIES["ghe1_not_in_employee_master"] = _ghe(("GHE-1",))
QUERIES["ghe2_shared_employee_bank"] = _ghe(("GHE-2",))
QUERIES["ghe3_no_paye"] = _ghe(("GHE-3",))
QUERIES["ghe4_no_pension"] = _ghe(("GHE-4",))
QUERIES["ghe5_ghost_employees"] = _ghe(None)


# ---------------------------------------------------------------- VAT / WHT
from ..operators.vat_wht import detect_vat_wht_issues, remitted_periods  # noqa: E402

VAT_COLS = ["issue_type", "vendor_name", "payment_amount", "expected_tax", "remittance_status",
            "estimated_liability", "period", "risk_level", "details", "rule_id", "row_id"]


def _vat(rules: tuple[str, ...] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixture_tables(spark, sf_dir)
        return boundary(detect_vat_wht_issues(t.ap, t.tax_remittance, asof=ASOF, include=rules), VAT_COLS)
    return run


@query("vat1_remitted_periods")
def _vat1(spark, sf_dir):
    return remitted_periods(fixture_tables(spark, sf_dir).tax_remittance)


QUERIES["vat2_vat_under_deducted"] = _vat(("VAT-2",))
QUERIES["vat3_vat_unremitted"] = _vat(("VAT-3",))
QUERIES["vat4_wht_under_deducted"] = _vat(("VAT-4",))
QUERIES["vat5_wht_unremitted"] = _vat(("VAT-5",))
QUERIES["vat6_vat_wht_issues"] = _vat(None)

# ---------------------------------------------------------------- expenses
from ..functions.dates import month_text  # noqa: E402
from ..operators.expenses import detect_overstated_expenses, monthly_spend, prepared  # noqa: E402

EXP_COLS = ["category", "transaction_amount", "baseline_average", "deviation_pct", "date", "risk_level", "details",
            "rule_id"]


def _exp_out(df: DataFrame) -> DataFrame:
    return boundary(df, EXP_COLS).withColumn("baseline_average", F.round("baseline_average", 2)) \
        .withColumn("deviation_pct", F.round("deviation_pct", 2))


def _exp(rules: tuple[str, ...] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _exp_out(detect_overstated_expenses(fixture_tables(spark, sf_dir).ap, include=rules))
    return run


@query("exp1_category")
def _exp1(spark, sf_dir):
    return prepared(fixture_tables(spark, sf_dir).ap).select(F.col("_rid").alias("row_id"), "category")


@query("exp2_monthly_spend")
def _exp2(spark, sf_dir):
    m = monthly_spend(prepared(fixture_tables(spark, sf_dir).ap))
    return m.select("category", month_text(F.col("month")).alias("month"),
                    F.col("monthly_total").cast("double").alias("monthly_total"), "txn_count",
                    F.round("txn_mean", 2).alias("txn_mean"), F.round("txn_std", 2).alias("txn_std"))


QUERIES["exp3_monthly_spike"] = _exp(("EXP-3",))
QUERIES["exp4_sigma_outlier"] = _exp(("EXP-4",))
QUERIES["exp5_round_number"] = _exp(("EXP-5",))
QUERIES["exp6_overstated_expenses"] = _exp(None)

# ---------------------------------------------------------------- filing
from ..operators.filing import detect_tax_filing_risk, obligations, observed_months  # noqa: E402


@query("txf1_observed_months")
def _txf1(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return observed_months(t.ap, t.payroll, t.tax_remittance).select(month_text(F.col("month")).alias("month"))


@query("txf2_obligations")
def _txf2(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    g = obligations(observed_months(t.ap, t.payroll, t.tax_remittance), t.ap, t.payroll)
    return g.select(month_text(F.col("month")).alias("period"), "tax_type",
                    F.date_format("due_date", "yyyy-MM-dd").alias("due_date"))


@query("txf3_remitted_periods")
def _txf3(spark, sf_dir):
    return remitted_periods(fixture_tables(spark, sf_dir).tax_remittance, require_remittance_date=False)


def _txf(status: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixture_tables(spark, sf_dir)
        out = detect_tax_filing_risk(t.tax_remittance, t.payroll, t.ap, asof=ASOF)
        return out if status is None else out.where(F.col("status") == status)
    return run


QUERIES["txf4_missed_filings"] = _txf("Missed")
QUERIES["txf5_at_risk_filings"] = _txf("At Risk")
QUERIES["txf6_tax_filing_risk"] = _txf(None)

# ---------------------------------------------------------------- duplicates
from ..operators.duplicates import detect_duplicate_payments  # noqa: E402
from ..operators.exposure import cluster_exposure  # noqa: E402

DUP_COLS = ["vendor_name", "amount_1", "date_1", "amount_2", "date_2", "invoice_ref", "flagged_amount",
            "risk_level", "details", "rule_id", "row_id_1", "row_id_2", "days_apart"]


def _dup(rules: tuple[str, ...] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boundary(detect_duplicate_payments(fixture_tables(spark, sf_dir).ap, include=rules), DUP_COLS)
    return run


QUERIES["dup1_same_invoice"] = _dup(("DUP-1",))
QUERIES["dup2_near_amount_week"] = _dup(("DUP-2",))
QUERIES["dup3_no_invoice_month"] = _dup(("DUP-3",))
QUERIES["dup4_duplicate_payments"] = _dup(None)


@query("dup6_exact_copies")
def _dup6(spark, sf_dir):
    """AP without row ids, with payments whose invoice and cents fit a multiple of 97 there thrice: equal rows pair up.

    Which of two payments of one instant comes first follows from their ids, so amounts are given as low and high.
    """
    ap = fixture_tables(spark, sf_dir).ap.drop("row_id")
    cents = (F.col("amount") * 100).cast("bigint")
    times = F.when((cents % 97 == 0) & F.col("invoice_number").isNotNull(), 3).otherwise(1)
    copied = ap.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")
    out = detect_duplicate_payments(copied).select(
        F.least("amount_1", "amount_2").alias("low_amount"), F.greatest("amount_1", "amount_2").alias("high_amount"),
        "date_1", "date_2", "rule_id", "days_apart")
    return boundary(out)



@query("dup7_payment_clusters")
def _dup7(spark, sf_dir):
    return boundary(cluster_exposure(detect_duplicate_payments(fixture_tables(spark, sf_dir).ap)))


# ---------------------------------------------------------------- summaries and report
from ..operators.summaries import (duplicate_summary, expense_summary, filing_summary,  # noqa: E402
                                   ghost_summary, vat_summary)
from ..plans import report as rpt  # noqa: E402
from ..plans.export import export_manifest  # noqa: E402
from ..plans.scan import run_scan, unified_findings  # noqa: E402

FIXTURE_REVENUE = 1000000000000


def _scan(spark: SparkSession, sf_dir: str, texts: bool = True):
    """The full scan reads AP in four families, so AP is written once, as compressed columns: a cache of them takes
    several times their room.  Rollups of amounts do without the findings' texts."""
    return run_scan(fixture_tables(spark, sf_dir), asof=ASOF, sort=False, materialize="files", texts=texts)


@query("dup5_summary")
def _dup5(spark, sf_dir):
    return boundary(duplicate_summary(detect_duplicate_payments(fixture_tables(spark, sf_dir).ap, sort=False)))


@query("vat7_summary")
def _vat7(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return boundary(vat_summary(detect_vat_wht_issues(t.ap, t.tax_remittance, asof=ASOF, sort=False)))


@query("exp7_summary")
def _exp7(spark, sf_dir):
    return boundary(expense_summary(detect_overstated_expenses(fixture_tables(spark, sf_dir).ap, sort=False)))


@query("gh6_ghost_summary")
def _gh6(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return boundary(ghost_summary(detect_ghost_vendors(t.ap, t.vendor_master),
                                  detect_ghost_employees(t.payroll, t.employee_master)))


@query("txf7_summary")
def _txf7(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return filing_summary(detect_tax_filing_risk(t.tax_remittance, t.payroll, t.ap, asof=ASOF, sort=False))


UNIFIED_COLS = ["category", "sub_category", "entity", "amount", "risk_level", "finding_date", "details", "finding_id"]


@query("rpt1_full_scan_findings")
def _rpt1(spark, sf_dir):
    return boundary(unified_findings(_scan(spark, sf_dir), exposure=True), [*UNIFIED_COLS, "exposure"])


@query("rpt2_leakage_by_category")
def _rpt2(spark, sf_dir):
    return boundary(rpt.leakage_by_category(_scan(spark, sf_dir, texts=False), revenue=FIXTURE_REVENUE))


@query("rpt3_category_metrics")
def _rpt3(spark, sf_dir):
    return boundary(rpt.category_metrics(_scan(spark, sf_dir, texts=False)))


@query("rpt4_leakage_breakdown")
def _rpt4(spark, sf_dir):
    return boundary(rpt.leakage_breakdown(_scan(spark, sf_dir, texts=False)))


@query("rpt5_findings_summary")
def _rpt5(spark, sf_dir):
    return boundary(rpt.findings_summary(_scan(spark, sf_dir, texts=False)))


@query("rpt6_export_manifest")
def _rpt6(spark, sf_dir):
    return export_manifest(_scan(spark, sf_dir, texts=False))


@query("rpt7_top_actions")
def _rpt7(spark, sf_dir):
    return boundary(rpt.top_actions(_scan(spark, sf_dir)))


@query("rpt8_recommended_actions")
def _rpt8(spark, sf_dir):
    return boundary(rpt.recommended_actions(_scan(spark, sf_dir, texts=False)))


@query("rpt9_findings_preview")
def _rpt9(spark, sf_dir):
    return boundary(rpt.findings_preview(_scan(spark, sf_dir)), UNIFIED_COLS + ["bank_account", "rank"])


@query("rpt10_narrative")
def _rpt10(spark, sf_dir):
    return rpt.narrative(_scan(spark, sf_dir, texts=False))


@query("rpt11_clean_text")
def _rpt11(spark, sf_dir):
    return boundary(rpt.clean_findings_text(_scan(spark, sf_dir)), UNIFIED_COLS)

# ---------------------------------------------------------------- sources
from ..config import DEFAULT_RULES  # noqa: E402
from ..fixed_values import EXPECTED_COLUMNS  # noqa: E402
from ..sources.contracts import validate_columns  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402
from ..sources.ingest import (CSV_OPTIONS, coerce_types, data_profile, load_table, prepare_table,  # noqa: E402
                              quarantine, record_counts, rejected_values)


def raw_ap_export(ap: DataFrame) -> DataFrame:
    """The AP table as a user's spreadsheet export: free-form headers, every
    value as text, day-first dates.  Used to drive the ingest path."""
    return ap.select(
        F.col("row_id").alias("Row ID"),
        F.date_format("transaction_date", "dd/MM/yyyy").alias("Date"),
        F.date_format("payment_date", "yyyy-MM-dd HH:mm:ss").alias("Paid Date"),
        F.col("vendor_name").alias(" Supplier "),
        F.col("amount").cast("string").alias("Amount"),
        F.col("invoice_number").alias("Invoice No"),
        F.col("vat_amount").cast("string").alias("VAT"),
        F.col("wht_amount").cast("string").alias("Withholding-Tax"),
        F.col("expense_category").alias("Category"),
        F.col("bank_account").alias("Account Number"),
    )


@query("src6_typed_ap_load")
def _src6(spark, sf_dir):
    loaded = prepare_table(raw_ap_export(fixture_tables(spark, sf_dir).ap), "ap").table
    return boundary(loaded.select(
        "row_id", F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"),
        F.date_format("payment_date", "yyyy-MM-dd").alias("payment_date"), "vendor_name", "amount",
        "invoice_number", "vat_amount", "wht_amount", "expense_category", "bank_account"))


@query("src1_csv_round_trip")
def _src1(spark, sf_dir):
    """AP rendered as CSV records with quotes, commas and line breaks in names, and parsed with the reader's options."""
    ap = fixture_tables(spark, sf_dir).ap
    name = F.concat(F.col("vendor_name"), F.lit(' "Q", x\ny'))
    rows = ap.select("row_id", name.alias("vendor_name"), F.col("amount").cast("string").alias("amount"), "invoice_number")
    options = {**CSV_OPTIONS, "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    record = F.to_csv(F.struct(*rows.columns), options)
    parsed = rows.select(F.from_csv(record, "row_id string, vendor_name string, amount string, invoice_number string", options).alias("r"))
    typed = prepare_table(parsed.select("r.*").withColumn("transaction_date", F.lit("2026-01-31")), "ap").table
    return boundary(typed.select("row_id", "vendor_name", "amount", "invoice_number"))


@query("src3_contract_check")
def _src3(spark, sf_dir):
    """Each table without its last required column: what the contract misses, beside its rows."""
    out = None
    for name, df in fixture_tables(spark, sf_dir).items():
        cut = EXPECTED_COLUMNS[name]["required"][-1]
        check = validate_columns([c for c in df.columns if c != cut], name)
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.lit(validate_columns(df.columns, name).is_valid).alias("is_valid"),
            F.lit(check.is_valid).alias("is_valid_cut"), F.lit(",".join(check.missing_required)).alias("missing"),
            F.lit(len(check.available_optional)).cast("bigint").alias("optional"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("src10_csv_scan")
def _src10(spark, sf_dir):
    """AP written as CSV files with quotes, commas and line breaks in names, and scanned by splits."""
    ap = fixture_tables(spark, sf_dir).ap
    name = F.concat(F.col("vendor_name"), F.lit(' "Q", x\ny'))
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows = ap.select("row_id", name.alias("Vendor Name"), F.col("amount").cast("string").alias("amount"), "invoice_number")
    rows.write.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "mode"}, header=True,
                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    loaded = load_table(spark, path, "vendor_master", fmt="csv", multi_line="splits").table
    return boundary(loaded.select("row_id", "vendor_name", "amount", "invoice_number"))


def spelled_ap(ap: DataFrame) -> DataFrame:
    """AP as text: amounts with a decimal comma, VAT with one in some rows, dates with the month first, and values that can't be read."""
    comma = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    cents = F.col("amount") * 100 % 100
    return ap.select(
        "row_id", "vendor_name", F.when(F.col("amount") > 2_000_000, F.lit("about 2m")).otherwise(F.concat(comma("amount"), F.lit(" \u20a6"))).alias("amount"),
        F.when(cents == 0, comma("vat_amount")).otherwise(F.format_number("vat_amount", 2)).alias("vat_amount"),
        F.format_number("wht_amount", 2).alias("wht_amount"), F.date_format("transaction_date", "MM/dd/yyyy").alias("transaction_date"),
        F.when(F.day("payment_date") == 29, F.lit("31/02/2026")).otherwise(F.date_format("payment_date", "dd/MM/yyyy")).alias("payment_date"))


@query("src11_column_formats")
def _src11(spark, sf_dir):
    return prepare_table(spelled_ap(fixture_tables(spark, sf_dir).ap), "ap", infer_formats=True).formats


@query("src12_rejected_values")
def _src12(spark, sf_dir):
    return rejected_values(prepare_table(spelled_ap(fixture_tables(spark, sf_dir).ap), "ap", infer_formats=True).checked)


@query("src13_accepted_rows")
def _src13(spark, sf_dir):
    """The rows that a quarantine keeps, read back from the one pass that writes kept and rejected ones."""
    checked = prepare_table(spelled_ap(fixture_tables(spark, sf_dir).ap), "ap", infer_formats=True).checked
    kept, _ = quarantine(checked, f"{checkpoint_dir(spark).rstrip('/')}/quarantine-{uuid.uuid4().hex}")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return boundary(kept.select("row_id", "amount", "vat_amount", "wht_amount", day("transaction_date"), day("payment_date")))


@query("src7_coercion")
def _src7(spark, sf_dir):
    """Dates and money in several spellings, one per column, read back from text."""
    ap = fixture_tables(spark, sf_dir).ap
    text = ap.select(
        "row_id", F.date_format("transaction_date", "d MMM yyyy").alias("transaction_date"),
        F.concat(F.date_format("payment_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z")).alias("payment_date"),
        F.date_format("payment_date", "M/d/yyyy").alias("date_added"), F.date_format("payment_date", "dd-MM-yyyy").alias("date_joined"),
        F.concat(F.lit("\u20a6"), F.format_number("amount", 2)).alias("amount"), F.concat(F.lit("NGN "), F.col("vat_amount")).alias("vat_amount"),
        F.when(F.col("amount") > 1000000, F.lit("oops")).otherwise(F.col("wht_amount").cast("string")).alias("wht_amount"))
    out = coerce_types(text, replace(DEFAULT_RULES, column_formats=(("date_added", "M/d/yyyy"),)))
    stamp = "yyyy-MM-dd HH:mm:ss.SSS"
    return boundary(out.select("row_id", *[F.date_format(c, stamp).alias(c) for c in ("transaction_date", "payment_date", "date_added", "date_joined")],
                               "amount", "vat_amount", "wht_amount"))


def _typed(view: str, renames: dict[str, str], dates: list[str]):
    """A table as text under a user's headers, through the ingest path and back."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(fixture_tables(spark, sf_dir), view)
        text = df.select(*[F.col(c).cast("string").alias(renames.get(c, f" {c.upper()} ")) for c in df.columns])
        out = prepare_table(text, view, add_row_id=False).table
        return boundary(out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c in dates else F.col(c) for c in df.columns]))
    return run


QUERIES["src6_typed_payroll_load"] = _typed("payroll", {"employee_name": "Staff-Name", "gross_salary": "Gross Salary"}, ["month"])
QUERIES["src6_typed_tax_load"] = _typed("tax_remittance", {}, ["remittance_date"])
QUERIES["src6_typed_vendor_master_load"] = _typed("vendor_master", {"vendor_name": "Vendor"}, ["date_added"])
QUERIES["src6_typed_employee_master_load"] = _typed("employee_master", {}, [])


@query("src8_ap_profile")
def _src8(spark, sf_dir):
    return boundary(data_profile(fixture_tables(spark, sf_dir).ap))


@query("src8_profiles")
def _src8_all(spark, sf_dir):
    """The profile of each of the five tables."""
    parts = [data_profile(df).select(F.lit(name).alias("table"), "*") for name, df in fixture_tables(spark, sf_dir).items()]
    return boundary(reduce(DataFrame.unionByName, parts))


@query("src9_record_counts")
def _src9(spark, sf_dir):
    return record_counts(fixture_tables(spark, sf_dir))


# ---------------------------------------------------------------- names and tax arithmetic
from ..functions.names import normalize_name  # noqa: E402
from ..functions import tax as tx  # noqa: E402


@query("nam1_normalized_names")
def _nam1(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    names = (t.ap.select(F.lit("ap").alias("source"), "vendor_name")
             .unionByName(t.vendor_master.select(F.lit("vendor_master").alias("source"), "vendor_name"))
             .distinct())
    return names.select("source", "vendor_name", normalize_name("vendor_name").alias("normalized"))


@query("tax1_vat_due")
def _tax1(spark, sf_dir):
    ap = fixture_tables(spark, sf_dir).ap
    return boundary(ap.select("row_id", "amount", tx.vat_on(F.col("amount")).alias("vat_due")))


@query("tax2_wht_due")
def _tax2(spark, sf_dir):
    ap = fixture_tables(spark, sf_dir).ap
    cat = F.lower(F.coalesce(F.col("expense_category"), F.lit("nan")))
    kw = tx.wht_category(cat)
    return boundary(ap.select("row_id", "amount", kw.alias("wht_category"), tx.wht_rate(kw).alias("wht_rate"),
                              tx.wht_on(F.col("amount"), cat).alias("wht_due")))


@query("tax3_paye_annual")
def _tax3(spark, sf_dir):
    p = fixture_tables(spark, sf_dir).payroll
    annual = (p.groupBy("employee_name", F.year("month").cast("bigint").alias("year"))
              .agg(F.sum("gross_salary").alias("annual_gross")))
    return boundary(annual.withColumn("paye", tx.paye_on(F.col("annual_gross"))))


@query("tax4_late_penalty")
def _tax4(spark, sf_dir):
    from ..functions.dates import days_floor, lit_ts
    t = fixture_tables(spark, sf_dir)
    g = obligations(observed_months(t.ap, t.payroll, t.tax_remittance), t.ap, t.payroll)
    d = days_floor(F.col("due_date").cast("timestamp_ntz"), lit_ts(ASOF))
    return (g.select(month_text(F.col("month")).alias("period"), "tax_type", d.alias("days_late"))
            .where(F.col("days_late") > 0)
            .withColumn("penalty", tx.late_penalty(F.col("tax_type"), F.col("days_late"))))


@query("tax5_vat_applicable")
def _tax5(spark, sf_dir):
    ap = fixture_tables(spark, sf_dir).ap
    return boundary(ap.select("row_id", "amount", tx.should_have_vat(F.col("amount")).alias("vat_applicable")))


@query("tax6_filing_due_dates")
def _tax6(spark, sf_dir):
    return _txf2(spark, sf_dir)


@query("tax7_risk_tiers")
def _tax7(spark, sf_dir):
    u = unified_findings(_scan(spark, sf_dir))
    return u.groupBy("category", "risk_level").agg(F.count(F.lit(1)).alias("findings"))


# ---------------------------------------------------------------- entity resolution (no SQL oracle)
from ..operators.entity_resolution import group_vendors, score_pairs  # noqa: E402


def _paid_vs_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name paid on a bank account against the master's name for that account."""
    t = fixture_tables(spark, sf_dir)
    paid = t.ap.select("vendor_name", "bank_account").distinct()
    master = t.vendor_master.select(F.col("vendor_name").alias("master_name"), "bank_account")
    return score_pairs(paid.join(master, "bank_account"), "vendor_name", "master_name")


@query("nam2_similarity_scores")
def _nam2(spark, sf_dir):
    return _paid_vs_master(spark, sf_dir).select("bank_account", "vendor_name", "master_name", "score")


@query("nam3_same_vendor")
def _nam3(spark, sf_dir):
    return _paid_vs_master(spark, sf_dir).select("bank_account", "vendor_name", "master_name", "same_vendor")


@query("nam4_vendor_groups")
def _nam4(spark, sf_dir):
    return group_vendors(fixture_tables(spark, sf_dir).ap, "vendor_name", "row_id")
