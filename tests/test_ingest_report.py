import os
import tempfile

import pytest
from conftest import ASOF, ap_frame
from pyspark.sql import functions as F

from ledgerlens.sources.contracts import auto_map_columns, normalize_name, validate_columns
from ledgerlens.sources.ingest import coerce_types, data_profile, load_table, load_tables, read_table


def test_contract_helpers():
    assert normalize_name(" Amount (NGN) ") == "amount_(ngn)"
    assert normalize_name("Txn-Date") == "txn_date"
    v = validate_columns(["vendor_name", "amount", "bank_account"], "ap")
    assert not v.is_valid and v.missing_required == ["transaction_date"] and v.available_optional == ["bank_account"]
    assert validate_columns(["x"], "nope").is_valid is False
    m = auto_map_columns(["Supplier", "date", "value", "ref"], "ap")
    assert m == {"Supplier": "vendor_name", "date": "transaction_date", "value": "amount", "ref": "invoice_number"}
    # an alias never renames onto a column that already exists
    assert "invoice" not in auto_map_columns(["invoice", "invoice_number", "vendor_name"], "ap")


def test_csv_load_round_trip(spark):
    d = tempfile.mkdtemp(prefix="ledgerlens-csv-")
    path = os.path.join(d, "ap.csv")
    with open(path, "w") as f:
        f.write("Date,Supplier,Amount,Invoice No\n"
                "2026-01-05,Acme Ltd,\"1,250.50\",INV-1\n"
                "13/02/2026,Beta,oops,INV-2\n"
                "not a date,Gamma,100,\n")
    loaded = load_table(spark, path, "ap")
    assert loaded.error is None
    rows = loaded.table.orderBy("row_id").collect()
    assert [str(r["transaction_date"])[:10] if r["transaction_date"] else None for r in rows] == \
        ["2026-01-05", "2026-02-13", None]
    assert [r["amount"] for r in rows][0] == 1250.5 and rows[1]["amount"] is None
    assert read_table(spark, os.path.join(d, "missing.parquet")) is None
    bad = os.path.join(d, "pay.csv")
    with open(bad, "w") as f:
        f.write("employee,salary\nA,1\n")
    assert load_table(spark, bad, "payroll").error == "missing columns: month"
    prof = data_profile(loaded.table).first()
    assert prof["rows"] == 3 and prof["date_from"] == "2026-01-05" and prof["total_amount_text"] == "₦1,350.50"


def test_report_totals_reconcile(spark):
    from ledgerlens.plans import report
    from ledgerlens.plans.scan import run_scan
    from ledgerlens.sources.fixtures import fixture_tables
    t = fixture_tables(spark, "/root/testdata/sf0.001")
    scan = run_scan(t, asof="2001-12-18", sort=False)
    leak = {r["category"]: r["amount"] for r in report.leakage_by_category(scan).collect()}
    assert leak["Total"] == sum(v for k, v in leak.items() if k != "Total")
    actions = report.top_actions(scan).collect()
    assert len(actions) == 3 and [a["rank"] for a in actions] == [1, 2, 3]
    clean = report.clean_findings_text(scan).where(F.col("details").rlike("[^\\x00-\\xff]")).count()
    assert clean == 0
    lines = [r["text"] for r in report.narrative(scan).orderBy("line").collect()]
    assert lines[0].startswith("This audit of the company") and lines[1] == "Breakdown by category:"


def test_driver_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert {k for k in q if k != "pipeline" and not k.startswith("op")} <= set(sql)


def test_csv_quotes_breaks_and_rejects(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-csv-"), "ap.csv")
    with open(path, "w") as f:
        f.write('Date,Supplier,Amount,amount \n2026-01-05T10:00:00.000Z,"ACME ""X"", Ltd","\u20a61,250.50",1\n'
                '5 Jan 2026,"two\nlines",NGN 7,2\n05-01-2026,z,1e,3\n')
    loaded = load_table(spark, path, "ap")
    rows = {r["vendor_name"]: (str(r["transaction_date"]), r["amount"]) for r in loaded.table.collect()}
    assert {k: (d, a and float(a)) for k, (d, a) in rows.items()} == {
        'ACME "X", Ltd': ("2026-01-05 10:00:00", 1250.5), "two\nlines": ("2026-01-05 00:00:00", 7.0), "z": ("2026-01-05 00:00:00", None)}
    assert loaded.validation.clashing == ["amount__2"]
    assert {r["column"]: (r["given"], r["rejected"]) for r in loaded.rejects.collect()} == {"transaction_date": (3, 0), "amount": (3, 1)}
    with pytest.raises(ValueError, match="payroll: could not read"):
        load_tables(spark, {"ap": path, "payroll": "/nowhere/pay.csv"})
    assert load_tables(spark, {"ap": path, "payroll": "/nowhere/pay.csv"}, strict=False).payroll is None


def test_wall_clock_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2026-03-08 02:30:00",)], "payment_date string")
        assert coerce_types(df).select(F.col("payment_date").cast("string")).first()[0] == "2026-03-08 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_export_skips_empty_families(spark):
    import tempfile
    from ledgerlens.plans.export import export_findings
    from ledgerlens.plans.scan import run_scan
    from ledgerlens.sources.fixtures import fixture_tables
    t = fixture_tables(spark, "/root/testdata/sf0.001")
    scan = run_scan(t.with_(payroll=None, employee_master=None), asof="2001-12-18", sort=False)
    out = tempfile.mkdtemp(prefix="ledgerlens-export-")
    written = export_findings(scan, out, fmt="csv")
    assert any(w.endswith("ghost_vendors") for w in written)
    assert not any(w.endswith("ghost_employees") for w in written)
    assert written[0].endswith("summary")
    for folder in written:
        assert spark.read.option("header", True).csv(folder).count() > 0


def test_ghost_family_always_reported(spark):
    from ledgerlens.plans import report
    from ledgerlens.plans.scan import run_scan
    from ledgerlens.sources.fixtures import fixture_tables
    t = fixture_tables(spark, "/root/testdata/sf0.001")
    scan = run_scan(t.with_(vendor_master=None, employee_master=None), asof="2001-12-18", sort=False)
    leak = {r["category"]: r["amount"] for r in report.leakage_by_category(scan).collect()}
    assert leak["Ghost"] == 0 and set(leak) == {"Duplicates", "VAT/WHT", "Expenses", "Ghost", "Tax Risk", "Total"}


def test_profiles_cover_the_five_tables(spark):
    from ledgerlens.plans.registry import QUERIES

    rows = {r["table"]: r for r in QUERIES["src8_profiles"](spark, "/root/testdata/sf0.001").collect()}
    counts = {r["table"]: r["rows"] for r in QUERIES["src9_record_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert {t: r["rows"] for t, r in rows.items()} == {t: n for t, n in counts.items() if t != "total"} and len(rows) == 5
    assert rows["payroll"]["total_amount"] > 0 and rows["vendor_master"]["total_amount"] is None and rows["employee_master"]["date_from"] is None
    assert rows["vendor_master"]["date_from"] <= rows["vendor_master"]["date_to"]


def test_export_takes_the_place_of_the_old_one_only_when_whole(spark, tmp_path):
    from pathlib import Path

    from ledgerlens.plans.export import export_findings
    from ledgerlens.plans.scan import ScanResult

    out = str(tmp_path / "export")
    dup = spark.createDataFrame([("A", 1)], "vendor_name string, flagged_amount int")
    assert export_findings(ScanResult(duplicates=dup), out) == [f"{out}/duplicate_payments"]
    broken = spark.range(1).selectExpr("raise_error('broken') AS vendor_name")
    with pytest.raises(Exception, match="broken"):
        export_findings(ScanResult(duplicates=dup, vat_wht=broken), out)
    assert spark.read.parquet(f"{out}/duplicate_payments").count() == 1   # the old export is as it was
    two = dup.union(dup)
    assert export_findings(ScanResult(expenses=two, duplicates=dup.limit(0)), out) == [f"{out}/overstated_expenses"]
    assert sorted(p.name for p in Path(out).iterdir() if not p.name.startswith((".", "_"))) == ["overstated_expenses"]
    assert not list(tmp_path.glob("export.old-*"))


def test_a_scan_gives_back_what_it_keeps(spark):
    from ledgerlens.plans.scan import run_scan
    from ledgerlens.tables import AuditTables

    ap = ap_frame(spark, [("1", "V", "2026-01-02 00:00:00", "100000.00", "I1", "0", "0", "Rent", "B")])
    with run_scan(AuditTables(ap=ap), asof=ASOF, materialize="persist", texts=False) as scan:
        assert ap.is_cached and scan.vat_wht.where("details IS NOT NULL").count() == 0 and scan.vat_wht.count() > 0
    assert not ap.is_cached
