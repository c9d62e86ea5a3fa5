
from pyspark.sql import functions as F

from ledgerlens.operators.duplicates import detect_duplicate_payments
from ledgerlens.operators.ghosts import detect_ghost_employees, detect_ghost_vendors
from ledgerlens.sources.fixtures import fixture_tables


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_row_order_invariance(spark):
    t = fixture_tables(spark, "/root/testdata/sf0.001")
    shuffled_ap = t.ap.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5))
    shuffled_pay = t.payroll.repartition(5, F.rand(9))
    assert _rows(detect_ghost_vendors(t.ap, t.vendor_master)) == \
        _rows(detect_ghost_vendors(shuffled_ap, t.vendor_master))
    assert _rows(detect_ghost_employees(t.payroll, t.employee_master)) == \
        _rows(detect_ghost_employees(shuffled_pay, t.employee_master))
    assert _rows(detect_duplicate_payments(t.ap, sort=False)) == \
        _rows(detect_duplicate_payments(shuffled_ap, sort=False))
