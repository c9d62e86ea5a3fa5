"""What the scan keeps and sends: AP as files, small keys, and no work on rows that a table's groups stand for."""

import pytest
from conftest import ASOF, ap_frame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_RULES
from ledgerlens.functions.dates import day_of, epoch_micros
from ledgerlens.functions.names import _normalize_any, normalize_name
from ledgerlens.operators import duplicates
from ledgerlens.operators.expenses import _is_multiple
from ledgerlens.operators.filing import observed_months
from ledgerlens.plans.scan import run_scan
from ledgerlens.session import written
from ledgerlens.tables import AuditTables


def test_files_give_what_a_lazy_scan_gives(spark):
    rows = [(f"r{i}", f"Vendor {i % 4} Ltd", f"2026-0{1 + i % 5}-0{1 + i % 9} 00:00:00", f"{100_000 * (1 + i % 3)}.00", f"I{i % 7}", "0", "0",
             "Rent", f"B{i % 2}") for i in range(60)]
    tax = spark.createDataFrame([("VAT", "2026-02", "2026-03-20")], "tax_type string, period_covered string, remittance_date string")
    tables = AuditTables(ap=ap_frame(spark, rows), tax_remittance=tax)
    lazy, kept = run_scan(tables, asof=ASOF), run_scan(tables, asof=ASOF, materialize="files")
    assert kept.vat_wht.inputFiles() and not kept.kept
    for family in ("duplicates", "vat_wht", "expenses", "tax_filing"):
        a, b = getattr(lazy, family), getattr(kept, family)
        assert a.count() > 0 and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_keys_are_sent_in_few_bits(spark):
    """A far and a near instant and amount fit the 31 bits of a spot."""
    ap = ap_frame(spark, [(f"r{i}", "V", f"{y}-12-31 23:59:59", a, inv, "0", "0", "Rent", "B")
                          for i, (y, a, inv) in enumerate((y, a, inv) for y in (1902, 2026, 9000) for a in ("0.01", "9999999999999999.99", "-5")
                                                          for inv in ("I1", ""))])
    keyed = duplicates._exploded(duplicates._prepare(ap, DEFAULT_RULES), DEFAULT_RULES, lambda r: True)
    low, high = keyed.agg(F.min("spot"), F.max("spot")).first()
    assert low >= 0 and high < 1 << 32


def test_near_amounts_make_few_keys(spark):
    """A payment stands in 1.9 keys of near amounts or fewer; one copy for the bin before most payments made it 2.3."""
    ap = spark.range(4000).selectExpr(
        "id AS row_id", "concat('V', id % 7) AS vendor_name", "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id % 1000 as int)) AS payment_date",
        "cast(1000 * exp(pmod(id * 7919, 4000) / 800) AS decimal(18,2)) AS amount")
    keyed = duplicates._exploded(duplicates._prepare(ap, DEFAULT_RULES), DEFAULT_RULES, lambda r: r == "DUP-2")
    assert 4000 < keyed.count() < 1.95 * 4000 and keyed.where("home").count() == 4000


def test_keys_are_counted_where_they_arrive(spark):
    rows = [(7, 1, True, 40), (7, 1, False, 90), (7, 1, True, 5), (1 << 40, 2, False, 3), (-1, 3, True, (1 << 31) - 1)]
    counted = duplicates._counted(spark.createDataFrame(rows, "k1 bigint, rule tinyint, home boolean, spot bigint"))
    got = {r["k1"]: (r["n"], r["home"], r["rule"], r["low"], r["high"]) for r in counted.collect()}
    assert got == {7: (3, True, 1, 5, 90), 0: (1, False, 2, 3, 3), (1 << 40) - 1: (1, True, 3, (1 << 31) - 1, (1 << 31) - 1)}
    plan = counted._jdf.queryExecution().sparkPlan().toString()   # before exchanges are added: only the asked one is there
    assert plan.index("REPARTITION_BY_COL") > plan.rindex("HashAggregate")
    whole = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert whole.count("Exchange hashpartitioning") == 1


def test_ids_are_written_without_a_dictionary(spark):
    parquet = pytest.importorskip("pyarrow.parquet")
    df = spark.range(1000).selectExpr("concat('row-', id) AS row_id", "concat('V', id % 3) AS vendor_name")
    kept = written(df)
    assert sorted(kept.collect()) == sorted(df.collect())
    group = parquet.ParquetFile(kept.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    assert not group.column(0).has_dictionary_page and group.column(1).has_dictionary_page and group.column(0).compression == "ZSTD"


def test_days_and_micros_of_instants(spark):
    values = ["1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "1900-02-03 04:05:06.789", "1582-10-10 12:00:00", "0001-01-01 00:00:00.000001",
              "9999-12-31 23:59:59.999999", "2026-03-29 00:00:00", None]
    df = spark.createDataFrame([(v,) for v in values], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = df.select(F.to_date("t").cast("string"), day_of(F.col("t")).cast("string"), epoch_micros(F.col("t"))).collect()
    assert all(r[0] == r[1] for r in got)
    assert [r[2] for r in got[:2]] == [-500_000, 0] and got[5][2] == 253_402_300_799_999_999 and got[7][2] is None


def test_round_amounts(spark):
    values = ["100000.00", "100000.01", "99999.99", "0", "-200000.00", "9999999999900000.00", "300000.00", None]
    df = spark.createDataFrame([(v,) for v in values], "a string").select(F.col("a").cast("decimal(18,2)").alias("a"))
    assert [r[0] for r in df.select(_is_multiple(F.col("a"), 100_000)).collect()] == [True, False, False, False, False, True, True, None]


def test_ascii_names_as_the_ordered_pass_gives_them(spark):
    parts = ["Acme", "LTD", "Ltd.", "& co", "and co", "nig", "nig ltd", "ent", "ent ltd", "co", "inc.", "#", "_", "x.y", "\x1c", "\n", "\x7f"]
    rows = [(f"{a}{s}{b} {c}",) for a in parts for b in parts for c in parts for s in (" ", "  ")]
    df = spark.createDataFrame(rows, "n string")
    got = df.select(normalize_name("n").alias("fast"), _normalize_any(F.col("n"), DEFAULT_RULES).alias("slow"))
    assert got.where(~F.col("fast").eqNullSafe(F.col("slow"))).count() == 0
    plan = df.select(normalize_name("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan


def test_months_are_made_of_groups_not_of_rows(spark):
    """The filter on the missing month stays above the view's own DISTINCT."""
    tax = spark.range(100).selectExpr("timestamp_ntz'2026-01-05' + make_dt_interval(cast(id % 3 as int)) AS d").distinct().selectExpr(
        "d + interval '45' day AS remittance_date")
    months = observed_months(None, None, tax)
    plan = months._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Range"):]
    assert "trunc" not in plan[plan.rindex("Aggregate"):] and below and [str(r["month"]) for r in months.collect()] == ["2026-02-01"]
