"""RPT-6: findings export, one output per non-empty family.

Each family is written to ``<path>/<family>`` as Parquet (or CSV with a
header); families with no rows are left out, as the workbook export skips empty
sheets.  ``write_unified`` instead writes the unified findings table once,
partitioned by category.

An export is built beside its place (``<path>.staging-<id>``): every family's plan
runs once, and what was written is counted from its files.  Only a whole export
takes the place of the one before, by two renames; one that breaks off leaves the
old one as it was (or, between the renames, whole at ``<path>.old-<id>``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .report import findings_summary
from .scan import ScanResult, unified_findings

SHEETS = {
    "duplicates": "duplicate_payments",
    "vat_wht": "vat_wht_issues",
    "expenses": "overstated_expenses",
    "ghost_vendors": "ghost_vendors",
    "ghost_employees": "ghost_employees",
    "tax_filing": "tax_filing_risk",
}
SUMMARY_SHEET = "summary"


def _write(df: DataFrame, target: str, fmt: str, mode: str) -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(target)
    else:
        w.format(fmt).save(target)


def export_manifest(scan: ScanResult) -> DataFrame | None:
    """(sheet, rows): the families that an export writes, those with findings."""
    out = None
    for attr, sheet in SHEETS.items():
        df = getattr(scan, attr)
        if df is not None:
            row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(sheet).alias("sheet"), "rows")
            out = row if out is None else out.unionByName(row)
    return None if out is None else out.where("rows > 0")


def _swap(spark, staging: str, path: str) -> None:
    """``staging`` takes the place of ``path``; both are on one file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, place, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (staging, path, path + ".old-" + staging.rsplit("-", 1)[1]))
    fs = place.getFileSystem(conf)
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"could not move {path} away")
    if not fs.rename(new, place):
        raise OSError(f"could not move {staging} to {path}")
    if had:
        fs.delete(old, True)


def _remove(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def export_findings(scan: ScanResult, path: str, fmt: str = "parquet") -> list[str]:
    """Write the summary table (RPT-5) and every non-empty family, and put them in the place of what ``path`` held.

    Returns the folders written.
    """
    path = path.rstrip("/")
    staging, sheets, spark = f"{path}.staging-{uuid.uuid4().hex}", [], None
    if scan.summaries():
        summary = findings_summary(scan)
        spark = summary.sparkSession
        _write(summary, f"{staging}/{SUMMARY_SHEET}", fmt, "error")
        sheets.append(SUMMARY_SHEET)
    for attr, sheet in SHEETS.items():
        df = getattr(scan, attr)
        if df is None:
            continue
        spark = df.sparkSession
        _write(df, f"{staging}/{sheet}", fmt, "error")
        back = spark.read.schema(df.schema).format(fmt)
        if (back.option("header", True) if fmt == "csv" else back).load(f"{staging}/{sheet}").isEmpty():
            _remove(spark, f"{staging}/{sheet}")
        else:
            sheets.append(sheet)
    if spark is not None:
        _swap(spark, staging, path)
    return [f"{path}/{s}" for s in sheets]


def write_unified(scan: ScanResult, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the unified findings table partitioned by category."""
    u = unified_findings(scan)
    u.write.mode(mode).partitionBy("category").format(fmt).save(path)
