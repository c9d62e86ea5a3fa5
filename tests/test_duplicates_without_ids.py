"""Duplicates of tables without row ids: what is shuffled, and what stays on disk."""

import time

import pytest
from conftest import ap_frame
from pyspark.sql import functions as F

from ledgerlens.operators import duplicates
from ledgerlens.operators.duplicates import detect_duplicate_payments
from ledgerlens.session import shuffles_freed, written


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    return {n.split("/")[-1] for n in names.split(",") if "/shuffle_" in n}


def until_freed(spark, before):
    """Shuffle files that have come; they are taken away in the background."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def payments(spark):
    """200 payments of vendors of their own, one of them thrice, and one with a near amount a day later."""
    rows = [(f"r{i}", f"Vendor {i}", "2026-01-05 00:00:00", "1000.00", f"I{i}", "0", "0", "Rent", "B") for i in range(200)]
    rows += [rows[7], rows[7], ("z", "Vendor 9 Ltd", "2026-01-06 00:00:00", "1001.00", " ", "0", "0", "Rent", "B")]
    return ap_frame(spark, rows).drop("row_id")


@pytest.mark.parametrize("keep", [False, True])
def test_only_rows_of_met_keys_are_numbered(spark, monkeypatch, keep):
    """No exchange numbers the whole table; the numbered rows are those of few keys, and copies have the ids they always had."""
    seen = []
    monkeypatch.setattr(duplicates, "written", lambda df, *slices: seen.append((df, out := written(df, *slices))) or out)
    ap = payments(spark)
    found = detect_duplicate_payments(ap, keep=keep)
    (table, kept), (_, sent) = seen
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 203 and sent.count() < 40
    got = {(r["row_id_1"], r["row_id_2"], r["rule_id"]) for r in found.collect()}
    h = {r["vendor_name"]: r["h"] for r in ap.select("vendor_name", F.format_string("%016x", F.xxhash64(*ap.columns)).alias("h")).collect()}
    a, b, c = (h[f"Vendor {x}"] for x in ("7", "9", "9 Ltd"))
    assert got == {(f"{a}-1", f"{a}-2", "DUP-1"), (f"{a}-1", f"{a}-3", "DUP-1"), (f"{a}-2", f"{a}-3", "DUP-1"), (f"{b}-1", f"{c}-1", "DUP-2")}


def test_rows_that_differ_in_a_column_or_its_null_are_no_copies(spark):
    same = ("x", "V", "2026-01-01 00:00:00", "5.00", "A")
    rows = [(*same, "0", "1", "Rent", "B"), (*same, "0", "1", "Rent", "C"), (*same, None, "1", "Rent", "B"), (*same, "0", "1", None, "B")]
    found = detect_duplicate_payments(ap_frame(spark, rows).drop("row_id")).collect()
    ids = {r[c] for r in found for c in ("row_id_1", "row_id_2")}
    assert len(found) == 6 and len(ids) == 4 and all(i.endswith("-1") for i in ids)


def test_no_shuffle_of_the_search_for_keys_is_left(spark):
    before = shuffle_files(spark)
    found = detect_duplicate_payments(payments(spark).repartition(3, "vendor_name"))
    assert not until_freed(spark, before)
    assert found.count() == 4


def test_the_setting_is_given_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, None)
    with pytest.raises(KeyError), shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
        raise KeyError
    assert spark.conf.get(name, None) == had
