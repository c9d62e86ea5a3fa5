from conftest import ASOF, ap_frame

from ledgerlens.operators.filing import detect_tax_filing_risk
from ledgerlens.operators.ghosts import detect_ghost_employees, detect_ghost_vendors


def v(rid, name, date, amount, bank):
    return (rid, name, date, amount, None, "0", "0", "Rent", bank)


def test_ghost_vendors(spark):
    ap = ap_frame(spark, [
        v("1", "Known Ltd", "2026-01-10 00:00:00", "100.00", "B1"),
        v("2", "Shadow Ltd", "2026-01-11 00:00:00", "600000.00", "B1"),   # not in master; shares B1
        v("3", "Shadow PLC", "2026-01-12 00:00:00", "1.00", "B2"),
        v("4", "Once Co", "2026-02-01 00:00:00", "2000000.00", "B3"),     # single large payment
        v("5", "New Vendor", "2026-03-03 00:00:00", "50.00", "B4"),       # paid 2 days after onboarding
        v("6", "Third", "2026-03-04 00:00:00", "50.00", "B1"),
    ])
    master = spark.createDataFrame([("Known Limited", "2025-01-01"), ("Once", "2025-01-01"),
                                    ("New Vendor", "2026-03-01"), ("Third", "2020-01-01")],
                                   "vendor_name string, date_added string")
    got = {(x["name"], x["red_flag_reason"]): x for x in detect_ghost_vendors(ap, master).collect()}
    assert got[("Shadow Ltd", "Not in vendor master list")]["total_paid"] == 600001
    assert ("Known Ltd / Shadow Ltd / Third", "3 vendors sharing same bank account") in got
    assert got[("Once Co", "Single large payment (hit-and-run pattern)")]["risk_level"] == "Low"
    assert ("New Vendor", "Created and paid within same week") in got
    # an empty master switches the not-in-master rule off
    empty = master.limit(0)
    assert not any(x["rule_id"] == "GHV-1" for x in detect_ghost_vendors(ap, empty).collect())


def test_ghost_employees_pension_suppression(spark):
    pay = spark.createDataFrame([
        ("1", "2026-01-01", "Ann", "700000", "0", "0", "K1"),      # no PAYE and no pension: only PAYE reported
        ("2", "2026-01-01", "Bob", "700000", "70000", None, "K2"),  # no pension only
        ("3", "2026-01-01", "Cy", "100", "10", "8", "K2"),
    ], "row_id string, month string, employee_name string, gross_salary string, paye_amount string, "
       "pension_amount string, bank_account string")
    master = spark.createDataFrame([("Ann",), ("Bob",), ("Cy",)], "employee_name string")
    got = {(x["name"], x["rule_id"]) for x in detect_ghost_employees(pay, master).collect()}
    assert ("Ann", "GHE-3") in got and ("Ann", "GHE-4") not in got
    assert ("Bob", "GHE-4") in got
    assert ("Bob / Cy", "GHE-2") in got


def test_filing_risk(spark):
    ap = ap_frame(spark, [v("1", "X", "2026-05-15 00:00:00", "1.00", "B")])
    tax = spark.createDataFrame([("VAT", "2026-05", "2026-06-01")],
                                "tax_type string, period_covered string, remittance_date string")
    got = {(x["tax_type"], x["period"]): x for x in detect_tax_filing_risk(tax, None, ap, asof=ASOF).collect()}
    # WHT for 2026-05 due 2026-06-21: 9 days overdue at 2026-06-30
    assert got[("WHT", "2026-05")]["status"] == "Missed" and got[("WHT", "2026-05")]["days_overdue"] == 9
    assert ("VAT", "2026-05") not in got
    # 2026-06 periods are due in July: more than 7 days away, not yet at risk
    assert ("VAT", "2026-06") not in got
    got2 = {(x["tax_type"], x["period"]): x["status"]
            for x in detect_tax_filing_risk(tax, None, ap, asof="2026-07-15").collect()}
    assert got2[("VAT", "2026-06")] == "At Risk"
