from decimal import Decimal

from conftest import ASOF, ap_frame

from ledgerlens.operators.expenses import detect_overstated_expenses
from ledgerlens.operators.vat_wht import detect_vat_wht_issues


def r(rid, date, amount, vat, wht, cat="Rent", name="V"):
    return (rid, name, date, amount, None, vat, wht, cat, "B")


def test_vat_wht_rules(spark):
    ap = ap_frame(spark, [
        r("1", "2026-03-01 00:00:00", "100000.00", "0", "10000.00"),      # VAT under-deducted (7,500)
        r("2", "2026-03-05 00:00:00", "100000.00", "7500.00", "0"),       # VAT unremitted (March not remitted) + WHT under
        r("3", "2026-04-05 00:00:00", "100000.00", "7500.00", "5000.00"),  # April VAT remitted, WHT not
        r("4", "2026-04-06 00:00:00", "40000.00", None, None),            # below VAT threshold; NULL WHT: nothing
        r("5", "2026-04-07 00:00:00", "-5.00", "0", "0"),                 # non-positive amount: skipped
    ])
    tax = spark.createDataFrame([(" vat ", "2026-04", "2026-05-20", "1"), ("WHT", "2026-03", "2026-04-20", "1")],
                                "tax_type string, period_covered string, remittance_date string, amount string")
    got = {(x["row_id"], x["rule_id"]): x for x in detect_vat_wht_issues(ap, tax, asof=ASOF).collect()}
    assert set(got) == {("1", "VAT-2"), ("2", "VAT-3"), ("2", "VAT-4"), ("3", "VAT-5")}
    assert got[("1", "VAT-2")]["estimated_liability"] == Decimal("7500.00")
    # 117 days since payment -> 25,000 + 87 * 200
    assert got[("2", "VAT-3")]["estimated_liability"] == Decimal("7500.00") + 25000 + 87 * 200
    assert got[("2", "VAT-4")]["expected_tax"] == Decimal("10000.00")   # rent: 10 %
    assert got[("3", "VAT-5")]["estimated_liability"] == Decimal("30000.00")
    assert got[("1", "VAT-2")]["details"].startswith("VAT of ₦7,500.00 should have been deducted")


def test_vat_without_tax_columns(spark):
    ap = ap_frame(spark, [r("1", "2026-03-05 00:00:00", "100000.00", "7500.00", "0")]).drop("vat_amount")
    rules = {x["rule_id"] for x in detect_vat_wht_issues(ap, None, asof=ASOF).collect()}
    assert rules == {"VAT-2", "VAT-4"}   # absent VAT column counts as 0


def test_expense_rules(spark):
    rows = []
    for m, total in zip(range(1, 7), [1000, 1000, 1000, 7000, 1000, 1000]):
        rows.append(r(f"m{m}", f"2026-{m:02d}-10 00:00:00", f"{total}.00", "0", "0", cat=" Fuel "))
    rows.append(r("x1", "2026-06-11 00:00:00", "1000.00", "0", "0", cat=" Fuel "))
    rows.append(r("big", "2026-06-12 00:00:00", "500000.00", "0", "0", cat="Other"))
    rows += [r(f"o{i}", "2026-06-13 00:00:00", "10.00", "0", "0", cat="Other") for i in range(12)]
    rows.append(r("rn", None, "200000.00", "0", "0", cat=None))
    got = {(x["rule_id"], x["category"], x["date"]) for x in detect_overstated_expenses(ap_frame(spark, rows)).collect()}
    assert ("EXP-3", "fuel", "2026-04") in got            # 7000 > 2 x mean(1000, 1000, 1000)
    assert not any(g[0] == "EXP-3" and g[2] in ("2026-02", "2026-03") for g in got)   # needs 3 prior months
    assert ("EXP-4", "other", "2026-06-12") in got        # 3-sigma outlier wins over EXP-5 on the same key
    assert ("EXP-5", "other", "2026-06-12") not in got
    assert ("EXP-5", "uncategorized", "N/A") in got        # NULL category and date
