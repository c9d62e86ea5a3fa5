"""Statistics of expenses: digits, merging, and what too many digits give."""

import random
import statistics
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.expenses import _deviations, category_stats, detect_overstated_expenses, monthly_moments, monthly_spend, prepared

SCHEMA = "row_id long, vendor_name string, payment_date timestamp_ntz, amount decimal(18,2), expense_category string"


def payments(spark, amounts, category="x"):
    import datetime as dt

    rows = [(i, "v", dt.datetime(2025, 1 + i % 7, 1 + i % 28) if i % 11 else None, a, category) for i, a in enumerate(amounts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("mean, std", [(10**9, 1), (5 * 10**9, 5), (10**13, 1), (100, 20)])
def test_std_keeps_its_digits(spark, mean, std):
    rng = random.Random(mean + std)
    amounts = [D(mean) + D(str(round(rng.gauss(0, std), 2))) for _ in range(300)]
    got = category_stats(monthly_moments(prepared(payments(spark, [*amounts, None])))).first()
    want = statistics.stdev(amounts)
    assert abs(got["_std"] - float(want)) < 1e-9 * float(want)
    assert got["_n"] == 301 and abs(got["_mean"] - float(statistics.mean(amounts))) <= 1e-15 * mean
    months = {r["month"].month: r["txn_std"] for r in monthly_spend(prepared(payments(spark, amounts))).collect()}
    for m in range(1, 8):
        own = statistics.stdev([a for i, a in enumerate(amounts) if i % 11 and 1 + i % 7 == m])
        assert abs(months[m] - float(own)) < 1e-9 * float(own)


def test_outlier_beside_a_large_mean(spark):
    amounts = [D(5 * 10**9) + D(i % 5) for i in range(200)] + [D(5 * 10**9 + 40)]
    got = detect_overstated_expenses(payments(spark, amounts), include=("EXP-4",)).collect()
    assert [r["transaction_amount"] for r in got] == [D(5 * 10**9 + 40)]


def test_squares_beyond_38_digits_are_merged_from_months(spark):
    big = D("9999999999999999.99")
    amounts = [big - D(i % 13) * D(10**14) for i in range(400)]
    got = category_stats(monthly_moments(prepared(payments(spark, amounts)))).first()
    assert abs(got["_std"] - float(statistics.stdev(amounts))) < 1e-6 * got["_std"]


def test_equal_amounts_have_no_spread(spark):
    got = category_stats(monthly_moments(prepared(payments(spark, [D("1000000000.01")] * 50)))).first()
    assert got["_std"] == 0
    one = category_stats(monthly_moments(prepared(payments(spark, [D("5.00")])))).first()
    assert one["_std"] is None and one["_mean"] == 5


def test_deviations_by_hand(spark):
    # 1.00, 2.00, 4.00: mean 7/3, squared deviations 14/3
    row = spark.range(1).select(_deviations(F.lit(3).cast("long"), F.lit(D("7.00")), F.lit(210000).cast("decimal(38,0)"), F.lit(-1.0)).alias("m2")).first()
    assert abs(row["m2"] - 14 / 3) < 1e-12
