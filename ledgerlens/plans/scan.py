"""RPT-1: the full scan over all audit tables.

Families run only when their inputs exist: duplicates, VAT/WHT and expenses
need AP; ghost vendors need AP and the vendor master; ghost employees need
payroll and the employee master; tax filing always runs.  Every family is a
lazy DataFrame; the keys that duplicates share, the statistics of categories and the
tables of names and banks are found at once.  AP feeds four
families, so it can be materialised once: ``persist`` (recomputed from
lineage if an executor is lost), ``checkpoint`` (written to the session's
reliable ``spark.checkpoint.dir``, which cuts the lineage) or ``files`` (the same
as compressed columns, of which each family reads its own).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, AuditRules
from ..functions.names import normalize_name
from ..operators.duplicates import NORM, detect_duplicate_payments
from ..operators.expenses import detect_overstated_expenses
from ..operators.exposure import with_exposure
from ..operators.filing import detect_tax_filing_risk
from ..operators.ghosts import detect_ghost_employees, detect_ghost_vendors
from ..operators.prepare import ap_date_column
from ..operators.summaries import (duplicate_summary, expense_summary, filing_summary, ghost_summary,
                                   vat_summary)
from ..operators.vat_wht import detect_vat_wht_issues
from ..session import checkpoint_dir, written
from ..tables import AuditTables


@dataclass(frozen=True)
class ScanResult:
    duplicates: DataFrame | None = None
    vat_wht: DataFrame | None = None
    expenses: DataFrame | None = None
    ghost_vendors: DataFrame | None = None
    ghost_employees: DataFrame | None = None
    tax_filing: DataFrame | None = None
    ap_present: bool = False
    #: what the scan keeps in storage until ``close``
    kept: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Give back the storage that ``materialize="persist"`` took; results are computed anew after that."""
        for df in self.kept:
            df.unpersist()

    def __enter__(self) -> ScanResult:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def summaries(self) -> dict[str, DataFrame]:
        """Family name -> one-row summary, for the families the scan ran."""
        out: dict[str, DataFrame] = {}
        if self.ap_present:
            out["Duplicates"] = duplicate_summary(self.duplicates)
            out["VAT/WHT"] = vat_summary(self.vat_wht)
            out["Expenses"] = expense_summary(self.expenses)
        g = ghost_summary(self.ghost_vendors, self.ghost_employees)
        if g is None and self.tax_filing is not None:
            # neither ghost detector could run: the family still reports zero
            g = self.tax_filing.sparkSession.range(1).select(
                F.lit(0).cast("bigint").alias("total_flagged"), F.lit(0).cast("decimal(38,2)").alias("total_amount"),
                F.lit(0).cast("bigint").alias("count"), F.lit("N/A").alias("top_entity"),
                F.lit(0).cast("decimal(38,2)").alias("top_amount"),
                F.lit("No ghost vendors or employees detected").alias("detail"))
        if g is not None:
            out["Ghost"] = g
        if self.tax_filing is not None:
            out["Tax Risk"] = filing_summary(self.tax_filing)
        return out


def _materialize(df: DataFrame | None, how: str) -> DataFrame | None:
    if df is None or how == "none":
        return df
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "files":
        return written(df)
    raise ValueError(f"unknown materialize mode {how!r}")


def _read_columns(ap: DataFrame | None, rules: AuditRules) -> DataFrame | None:
    """``ap`` to be kept: without the date column that no family reads, and with the names that the duplicates
    compare, which are read twice.  Rows without ids are known by all their columns, and stay as they are."""
    if ap is None or "row_id" not in ap.columns:
        return ap
    if ap_date_column(ap) == "payment_date":
        ap = ap.drop("transaction_date")
    return ap.withColumn(NORM, normalize_name("vendor_name", rules)) if "vendor_name" in ap.columns else ap


def run_scan(tables: AuditTables, *, asof, rules: AuditRules = DEFAULT_RULES, materialize: str = "none",
             sort: bool = False, texts: bool = True) -> ScanResult:
    """All families.  ``with run_scan(...) as scan`` gives back what ``persist`` keeps.  ``texts=False`` leaves the
    findings' ``details`` out, for rollups that only add amounts."""
    ap = tables.ap
    if materialize != "none":   # ``persist`` keeps the caller's own table
        ap = _materialize(ap if materialize == "persist" else _read_columns(ap, rules), materialize)
    have_ap = ap is not None
    tax = tables.tax_remittance   # read by two families, three times: filters on periods would reach what it is made of
    if materialize == "files":
        tax = _materialize(tax, materialize)
    return ScanResult(
        duplicates=detect_duplicate_payments(ap, rules, sort=sort, keep=materialize != "none") if have_ap else None,
        vat_wht=detect_vat_wht_issues(ap, tax, asof=asof, rules=rules, sort=sort, texts=texts)
        if have_ap else None,
        expenses=detect_overstated_expenses(ap, rules, sort=sort, texts=texts) if have_ap else None,
        ghost_vendors=detect_ghost_vendors(ap, tables.vendor_master, rules, sort=sort, texts=texts)
        if have_ap and tables.vendor_master is not None else None,
        ghost_employees=detect_ghost_employees(tables.payroll, tables.employee_master, rules, sort=sort, texts=texts)
        if tables.payroll is not None and tables.employee_master is not None else None,
        tax_filing=detect_tax_filing_risk(tax, tables.payroll, ap, asof=asof, rules=rules,
                                          sort=sort),
        ap_present=have_ap,
        kept=(ap,) if have_ap and materialize == "persist" else (),
    )


FINDING_COLS = ["category", "sub_category", "entity", "amount", "risk_level", "finding_date", "details",
                "finding_id", "bank_account"]


def unified_findings(scan: ScanResult, exposure: bool = False) -> DataFrame | None:
    """One long table of every finding: (category, sub_category, entity, amount,
    risk_level, finding_date, details, finding_id, bank_account); only ghosts have an account.

    ``exposure=True`` adds a column of that name: the sum over duplicates counts every
    surplus payment once (``operators.exposure``); NULL for the other families.  This
    finds the clusters of payments, so jobs run.
    """
    none = F.lit(None).cast("decimal(38,2)")

    def row(df, category, sub, entity, amount, date, fid, bank=F.lit(None).cast("string"), exposed=none):
        more = [exposed.alias("exposure")] if exposure else []
        return df.select(F.lit(category).alias("category"), sub.alias("sub_category"),
                         entity.cast("string").alias("entity"), amount.cast("decimal(38,2)").alias("amount"),
                         F.col("risk_level"), date.alias("finding_date"), F.col("details"),
                         fid.alias("finding_id"), bank.alias("bank_account"), *more)
    parts = []
    if scan.duplicates is not None:
        d = with_exposure(scan.duplicates) if exposure else scan.duplicates
        parts.append(row(d, "Duplicates", F.col("rule_id"), F.col("vendor_name"), F.col("flagged_amount"),
                         F.col("date_1"), F.concat_ws("|", F.lit("DUP"), "row_id_1", "row_id_2"),
                         exposed=F.col("exposure") if exposure else none))
    if scan.vat_wht is not None:
        v = scan.vat_wht
        parts.append(row(v, "VAT/WHT", F.col("issue_type"), F.col("vendor_name"), F.col("estimated_liability"),
                         F.col("period"), F.concat_ws("|", F.lit("VAT"), "rule_id", "row_id")))
    if scan.expenses is not None:
        e = scan.expenses
        parts.append(row(e, "Expenses", F.col("rule_id"), F.col("category"), F.col("transaction_amount"),
                         F.col("date"), F.concat_ws("|", F.lit("EXP"), "category", "date",
                                                    F.col("transaction_amount").cast("string"))))
    for df, tag in ((scan.ghost_vendors, "GHV"), (scan.ghost_employees, "GHE")):
        if df is not None:
            parts.append(row(df, "Ghost", F.col("red_flag_reason"), F.col("name"), F.col("total_paid"),
                             F.lit(None).cast("string"),
                             F.concat_ws("|", F.lit(tag), "red_flag_reason", F.coalesce("name", F.lit(""))),
                             F.col("bank_account")))
    if scan.tax_filing is not None:
        t = scan.tax_filing
        parts.append(row(t, "Tax Risk", F.col("status"), F.col("tax_type"), F.col("estimated_penalty"),
                         F.col("period"), F.concat_ws("|", F.lit("TXF"), "tax_type", "period")))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
