"""Edges of the rules, worked by hand from their thresholds."""

from conftest import ASOF, ap_frame

from ledgerlens.operators.expenses import detect_overstated_expenses
from ledgerlens.operators.filing import detect_tax_filing_risk
from ledgerlens.operators.ghosts import detect_ghost_employees, detect_ghost_vendors
from ledgerlens.operators.vat_wht import detect_vat_wht_issues


def pay(rid, name, date, amount, bank="B", vat="0", wht="0", cat="Rent"):
    return (rid, name, f"{date} 00:00:00", amount, None, vat, wht, cat, bank)


def test_vat_and_wht_tiers(spark):
    rows = [pay("1", "V", "2026-03-01", "50000.00"), pay("2", "V", "2026-03-01", "49999.99"), pay("3", "V", "2026-03-01", "6666666.67"),
            pay("4", "V", "2026-03-01", "6666666.53"), pay("5", "V", "2026-03-01", "666666.67"), pay("6", "V", "2026-03-01", "666666.53")]
    got = {(x["row_id"], x["rule_id"]): x["risk_level"] for x in detect_vat_wht_issues(ap_frame(spark, rows), None, asof=ASOF).collect()}
    vat = {k[0]: v for k, v in got.items() if k[1] == "VAT-2"}
    # 7.5 %: 500,000.00 / 499,999.99 / 50,000.00 / 49,999.99; below the threshold of 50,000 there is no VAT
    assert vat == {"1": "Low", "3": "High", "4": "Medium", "5": "Medium", "6": "Low"}
    wht = {k[0]: v for k, v in got.items() if k[1] == "VAT-4"}
    assert wht["1"] == "Low" and wht["5"] == "Medium"   # rent: 10 %, Medium from 50,000


def test_single_payment_and_onboarding_edges(spark):
    rows = [pay("1", "Five", "2026-01-01", "5000000.00", "B1"), pay("2", "Under", "2026-01-01", "4999999.99", "B2"),
            pay("3", "One", "2026-01-01", "1000000.00", "B3"), pay("4", "Less", "2026-01-01", "999999.99", "B4"),
            pay("5", "Week", "2026-01-08", "1.00", "B5"), pay("6", "Eight", "2026-01-09", "1.00", "B6"), pay("7", "Early", "2025-12-31", "1.00", "B7")]
    names = ("Five", "Under", "One", "Less", "Week", "Eight", "Early")
    master = spark.createDataFrame([(n, "2026-01-01" if n in names[4:] else "2020-01-01") for n in names], "vendor_name string, date_added string")
    got = {(x["name"], x["rule_id"]): x["risk_level"] for x in detect_ghost_vendors(ap_frame(spark, rows), master).collect()}
    assert got == {("Five", "GHV-3"): "Medium", ("Under", "GHV-3"): "Low", ("One", "GHV-3"): "Low", ("Week", "GHV-4"): "Medium"}


def test_first_row_follows_numeric_ids(spark):
    rows = [pay("10", "Acme Ltd", "2026-01-01", "1.00", "B10"), pay("9", "Acme PLC", "2026-01-01", "2.00", "B9")]
    ap = ap_frame(spark, rows)
    master = spark.createDataFrame([("Other", "2020-01-01")], "vendor_name string, date_added string")
    got = detect_ghost_vendors(ap.withColumn("row_id", ap["row_id"].cast("long")), master, include=("GHV-1",)).collect()
    assert [(x["name"], x["bank_account"]) for x in got] == [("Acme PLC", "B9")]


def test_no_deduction_limit(spark):
    schema = "row_id string, month string, employee_name string, gross_salary string, paye_amount string, pension_amount string, bank_account string"
    rows = [("1", "2026-01-01", "At", "600000", "0", "9", "K1"), ("2", "2026-01-01", "Below", "599999.99", "0", "9", "K2")]
    master = spark.createDataFrame([("At",), ("Below",)], "employee_name string")
    got = {(x["name"], x["rule_id"]) for x in detect_ghost_employees(spark.createDataFrame(rows, schema), master).collect()}
    assert got == {("At", "GHE-3")}


def test_spike_needs_more_than_double(spark):
    months = [1000, 1000, 1000, 2000, 1000, 1000, 2666.68]
    rows = [pay(str(i), "V", f"2026-0{i + 1}-10", f"{a:.2f}", cat="Fuel") for i, a in enumerate(months)]
    got = {x["date"] for x in detect_overstated_expenses(ap_frame(spark, rows), include=("EXP-3",)).collect()}
    assert got == {"2026-07"}   # 2,000 is just double the mean of 1,000; 2,666.68 is over double of 1,333.33


def test_round_number_edges(spark):
    rows = [pay(str(i), "V", f"2026-01-{i + 1:02d}", a, cat="Rent") for i, a in enumerate(["100000.00", "99999.99", "200000.00", "150000.00", "-100000.00"])]
    got = {float(x["transaction_amount"]) for x in detect_overstated_expenses(ap_frame(spark, rows), include=("EXP-5",)).collect()}
    assert got == {100000.0, 200000.0}


def test_filing_at_risk_days(spark):
    ap = ap_frame(spark, [pay("1", "X", "2026-05-15", "1.00")])
    status = {}
    for asof in ("2026-06-14", "2026-06-15", "2026-06-21", "2026-06-22"):
        got = {(x["tax_type"], x["period"]): x["status"] for x in detect_tax_filing_risk(None, None, ap, asof=asof).collect()}
        status[asof] = got.get(("VAT", "2026-05"))
    assert status == {"2026-06-14": None, "2026-06-15": "At Risk", "2026-06-21": "At Risk", "2026-06-22": "Missed"}
