"""Number and date spellings: votes, what is read, and what is set aside."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_RULES, AuditRules
from ledgerlens.operators.prepare import money
from ledgerlens.sources.formats import column_formats, with_formats
from ledgerlens.sources.ingest import checked_types, prepare_table, quarantine


def texts(spark, values, name="amount"):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], f"row_id string, {name} string")


POINT = {"1,234.56": "1234.56", "12.5": "12.50", "1234": "1234.00", " 7 ": "7.00", "1,234": "1234.00", "-5.25": "-5.25", "1e3": "1000.00", ".5": "0.50", "5.": "5.00",
         "₦1,000": "1000.00", "NGN 2,000,000.10": "2000000.10", "12,50": None, "1.234,56": None, "1,23,456": None, "oops": None, "": None, None: None, ".": None, "1 234.5": "1234.50"}
COMMA = {"1.234,56": "1234.56", "12,50": "12.50", "1234": "1234.00", "1.234": "1234.00", "-5,25": "-5.25", "₦ 1.000": "1000.00", "1,234.56": None, "12.5": None, "x": None}


@pytest.mark.parametrize("mark, cases", [("point", POINT), ("comma", COMMA)])
def test_money_is_read_right_or_not_at_all(spark, mark, cases):
    df = texts(spark, list(cases))
    got = {r["amount"]: r["m"] for r in df.select("amount", money(df, "amount", AuditRules(column_marks=(("amount", mark),))).alias("m")).collect()}
    assert got == {k: None if v is None else D(v) for k, v in cases.items()}


@pytest.mark.parametrize("values, votes, outcome", [
    (["1,234.56", "1,234", "5"], (1, 0, 1), "point"), (["12,50", "1.234", "7"], (0, 1, 1), "comma"), (["1,234", "2,345"], (0, 0, 2), "ambiguous"),
    (["12,50", "12.50"], (1, 1, 0), "ambiguous"), (["5", None, "", "oops"], (0, 0, 0), "none")])
def test_votes_on_the_decimal_mark(spark, values, votes, outcome):
    row = column_formats(texts(spark, values), ["amount"], []).first()
    assert (row["first_votes"], row["second_votes"], row["either"], row["outcome"]) == (*votes, outcome)


@pytest.mark.parametrize("values, outcome", [
    (["31/01/2026", "02/03/2026"], "day first"), (["01/31/2026", "02/03/2026"], "month first"), (["02/03/2026"], "ambiguous"),
    (["31/01/2026", "01/31/2026"], "ambiguous"), (["2026-01-31", "5 Jan 2026", "03/03/2026", None], "none"), (["13.01.2026"], "day first")])
def test_votes_on_the_order_of_dates(spark, values, outcome):
    assert column_formats(texts(spark, values, "payment_date"), [], ["payment_date"]).first()["outcome"] == outcome


def test_the_callers_formats_come_first(spark):
    df = spark.createDataFrame([("12,50", "01/31/2026")], "amount string, payment_date string")
    votes = column_formats(df, ["amount"], ["payment_date"])
    found = with_formats(AuditRules(), votes)
    assert dict(found.column_marks) == {"amount": "comma"} and dict(found.column_formats) == {"payment_date": "M/d/yyyy"}
    own = AuditRules(column_marks=(("amount", "point"),), column_formats=(("payment_date", "d/M/yyyy"),))
    assert with_formats(own, votes) == own


def test_a_table_with_decimal_commas_and_months_first(spark):
    rows = [("V", "1.234,56", "01/31/2026"), ("V", "12,50", "02/03/2026"), ("V", "7", "12/01/2026")]
    loaded = prepare_table(spark.createDataFrame(rows, "`Vendor Name` string, Amount string, `Transaction Date` string"), "ap", infer_formats=True)
    got = {(r["amount"], r["transaction_date"].strftime("%m-%d")) for r in loaded.table.collect()}
    assert got == {(D("1234.56"), "01-31"), (D("12.50"), "02-03"), (D("7.00"), "12-01")}
    assert {r["column"]: r["outcome"] for r in loaded.formats.collect()} == {"amount": "comma", "transaction_date": "month first"}


def test_quarantine_keeps_and_sets_aside_every_row(spark, tmp_path):
    rows = [("1", "10.00", "2026-01-01"), ("2", "12,50", "2026-01-01"), ("3", "oops", "32/13/2026"), ("4", None, ""), ("5", "99999999999999999999", "2026-01-02")]
    df = spark.createDataFrame(rows, "row_id string, amount string, payment_date string")
    kept, rejected = quarantine(checked_types(df), str(tmp_path / "q"))
    assert sorted(r["row_id"] for r in kept.collect()) == ["1", "4"]
    got = {(r["row_id"], r["column"], r["raw"], r["reason"]) for r in rejected.collect()}
    assert got == {("2", "amount", "12,50", "another decimal mark or too large"), ("3", "amount", "oops", "not a number"), ("3", "payment_date", "32/13/2026", "not a date"),
                   ("5", "amount", "99999999999999999999", "another decimal mark or too large")}
    assert kept.count() + rejected.select("row_id").distinct().count() == len(rows)
    assert kept.select(F.sum("amount")).first()[0] == D("10.00")


def test_formats_are_tried_on_text_of_their_shape_alone(spark):
    from ledgerlens.functions.dates import _shape, coerce_timestamp
    assert _shape("MMM d yyyy HH:mm") is None and _shape("yy/M/d") is None and _shape("ddMMyyyy") is None
    values = ["0031/01/2026", "31/01/2026", "+2026/1/2", "12026/1/2", "1/2/202", "5 Sep 2026", "5-jan-2026", "5  Jan 2026", "2026//1", "31-01-2026", ""]
    df = spark.createDataFrame([(v,) for v in values], "month string")
    plain = F.coalesce(*[F.try_to_date(F.trim("month"), f).cast("timestamp_ntz") for f in DEFAULT_RULES.date_formats])
    assert df.where(~coerce_timestamp(df, "month").eqNullSafe(plain)).count() == 0
    shapes = [_shape(f) for f in DEFAULT_RULES.date_formats]
    hit = df.select(*[F.count_if(F.col("month").rlike(s)) for s in shapes]).first()
    assert all(0 < n < len(values) / 2 for n in hit)


def test_the_votes_are_not_counted_again_with_their_result(spark, tmp_path):
    spark.createDataFrame([("1", "V", "12,50", "31/01/2026")], "row_id string, vendor_name string, amount string, transaction_date string").write.parquet(str(tmp_path / "t"))
    loaded = prepare_table(spark.read.parquet(str(tmp_path / "t")), "ap", infer_formats=True)
    assert {r["column"]: r["outcome"] for r in loaded.formats.collect()} == {"amount": "comma", "transaction_date": "day first"}
    assert "FileScan" not in loaded.formats._jdf.queryExecution().executedPlan().toString()
