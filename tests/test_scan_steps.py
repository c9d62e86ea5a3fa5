"""What the scan computes once, and what its rollups leave out."""

from conftest import ASOF, ap_frame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_RULES
from ledgerlens.operators import duplicates
from ledgerlens.operators.ghosts import detect_ghost_employees, detect_ghost_vendors
from ledgerlens.operators.vat_wht import detect_vat_wht_issues


def pay(rid, name, date, amount, inv=None, vat="0", wht="0", bank="B1"):
    return (rid, name, f"{date} 00:00:00", amount, inv, vat, wht, "Rent", bank)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ghost_rules_read_payments_once(spark, tmp_path):
    rows = [pay(f"r{i}", f"Vendor {i % 5} Ltd", "2026-01-05", "10.00", bank=f"B{i % 3}") for i in range(30)]
    ap_frame(spark, rows).write.parquet(str(tmp_path / "payments"))
    pay_cols = "row_id string, month string, employee_name string, gross_salary string, paye_amount string, pension_amount string, bank_account string"
    spark.createDataFrame([("1", "2026-01-01", "Ann", "700000", "0", "0", "K1"), ("2", "2026-01-01", "Bob", "700000", "1", "1", "K1")],
                          pay_cols).write.parquet(str(tmp_path / "salaries"))
    master = spark.createDataFrame([("Other", "2020-01-01")], "vendor_name string, date_added string")
    v = detect_ghost_vendors(spark.read.parquet(str(tmp_path / "payments")), master)
    e = detect_ghost_employees(spark.read.parquet(str(tmp_path / "salaries")))
    assert v.count() == 5 + 3 and {r["rule_id"] for r in e.collect()} == {"GHE-2", "GHE-3"}
    assert "payments" not in "".join(v.inputFiles()) and "salaries" not in "".join(e.inputFiles())


def test_two_rows_too_far_apart_are_not_sent(spark):
    """A day apart with amounts 8 % apart, and a week and a day apart with the same invoice a year later."""
    rows = []
    for i in range(40):
        rows += [pay(f"a{i}", f"Amount {i}", "2026-01-05", f"{1000 + 37 * i}.00", f"I{i}"),
                 pay(f"b{i}", f"Amount {i}", "2026-01-06", f"{1080 + 40 * i}.00", f"J{i}"),
                 pay(f"c{i}", f"Time {i}", f"2026-01-{1 + i % 20:02d}", "500.00", f"K{i}"),
                 pay(f"d{i}", f"Time {i}", f"2026-02-{6 + i % 20:02d}", "500.00", f"K{i}")]
    rows += [pay("x", "Near", "2026-01-05", "1000.00", "P"), pay("y", "Near", "2026-01-12", "1019.99", "Q"),
             pay("m", "Same", "2026-01-05", "1.00", "P"), pay("n", "Same", "2026-02-04", "9.00", "P"),
             pay("u", "Minus", "2026-01-05", "-1.00", "P"), pay("v", "Minus", "2026-01-06", "-9.00", "Q")]
    ap = ap_frame(spark, rows)
    keyed = duplicates._exploded(duplicates._prepare(ap, DEFAULT_RULES), DEFAULT_RULES, lambda r: True)
    sent = {r["rid"] for r in duplicates._met(keyed).collect()}
    assert {"x", "y", "m", "n", "u", "v"} <= sent and len(sent) <= 16   # few by chance of the bitmap
    for keep in (False, True):
        found = duplicates.detect_duplicate_payments(ap, keep=keep).collect()
        assert {(r["row_id_1"], r["row_id_2"], r["rule_id"], r["date_1"], r["date_2"]) for r in found} == {
            ("x", "y", "DUP-2", "2026-01-05", "2026-01-12"), ("m", "n", "DUP-1", "2026-01-05", "2026-02-04"), ("u", "v", "DUP-2", "2026-01-05", "2026-01-06")}


def test_vat_rollup_computes_amounts_only(spark):
    ap = ap_frame(spark, [pay("1", "V", "2026-03-05", "100000.00", vat="7500.00"), pay("2", "V", "2026-04-05", "100000.00", vat="7500.00")])
    tax = spark.createDataFrame([("VAT", "2026-04", "2026-05-20")], "tax_type string, period_covered string, remittance_date string")
    issues = detect_vat_wht_issues(ap, tax, asof=ASOF, texts=False)
    total = issues.agg(F.sum("estimated_liability").alias("s"))
    assert {(r["row_id"], r["rule_id"], r["period"]) for r in issues.collect()} == {
        ("1", "VAT-3", "2026-03"), ("1", "VAT-4", "2026-03"), ("2", "VAT-4", "2026-04")}
    assert "date_format" not in plan(total) and "Not deducted" not in plan(total)
