"""CSV by splits against the whole-file reader."""

import csv
import random

import pytest

from ledgerlens.sources.csv_splits import column_names, records
from ledgerlens.sources.ingest import load_table, read_table


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, name, rows, line_end="\n", header=("Row ID", "Vendor Name", "Amount", "a,b")):
    with open(folder / name, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=line_end)
        out.writerow(header)
        out.writerows(rows)


def odd_rows(seed, n):
    rng = random.Random(seed)
    parts = ["x", '"', "\n", "\r\n", ",", " ", "é", "plain text here", "\n\n", '""', "'"]
    return [(f"{seed}-{i}", "v" + "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) + "w", f"{i}.50",
             "long\n" * rng.choice([0, 0, 0, 0, 0, 0, 150]) + "z") for i in range(n)]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_splits_give_the_rows_of_the_whole_file_reader(spark, tmp_path, small_splits, line_end):
    for k in range(3):
        write(tmp_path, f"f{k}.csv", odd_rows(k, 60), line_end)
    path = str(tmp_path)
    got, want = read_table(spark, path, "csv", "splits"), read_table(spark, path, "csv", True)
    assert got.columns == want.columns and want.count() == 180
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert records(spark, path).select("block").distinct().count() > 20   # many tasks, and records over several splits


def test_a_record_over_many_splits_and_an_open_one(spark, tmp_path, small_splits):
    long = "line of a long text\n" * 400   # 8,000 characters, about 27 splits
    write(tmp_path, "a.csv", [("1", long, "2.00", "x"), ("2", "b", "3.00", "y")])
    got = read_table(spark, str(tmp_path / "a.csv"), None, "splits").collect()
    assert sorted(r["Row ID"] for r in got) == ["1", "2"] and max(len(r["Vendor Name"]) for r in got) == len(long)
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,x\n')
    assert read_table(spark, str(tmp_path / "open.csv"), None, "splits").count() == 1


def test_header_blank_lines_and_missing_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text('﻿"Vendor\nName",,A,a\n\n1,2,3,4\n\n', encoding="utf-8")
    rows = read_table(spark, str(tmp_path / "h.csv"), None, "splits")
    assert rows.columns == ["Vendor\nName", "_c1", "A2", "a3"] and [tuple(r) for r in rows.collect()] == [("1", "2", "3", "4")]
    assert column_names('x,"y ""q""",') == ["x", 'y "q"', "_c2"]
    assert read_table(spark, str(tmp_path / "none.csv"), None, "splits") is None
    (tmp_path / "empty.csv").write_text("")
    assert read_table(spark, str(tmp_path / "empty.csv"), None, "splits") is None


def test_load_takes_the_choice(spark, tmp_path, small_splits):
    rows = [(str(i), f"Vendor\n{i}", "2026-01-02", f"{i}.00") for i in range(1, 90)]
    write(tmp_path, "ap.csv", rows, header=("Row ID", "Supplier", "Date", "Amount"))
    for choice in (True, "splits"):
        table = load_table(spark, str(tmp_path / "ap.csv"), "ap", multi_line=choice).table
        assert table.count() == 89 and {r["vendor_name"] for r in table.collect()} == {r[1] for r in rows}
