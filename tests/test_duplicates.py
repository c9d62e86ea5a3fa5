import datetime as dt
import math
import random

from conftest import ap_frame

from ledgerlens.config import DEFAULT_RULES
from ledgerlens.operators import duplicates
from ledgerlens.operators.duplicates import detect_duplicate_payments


# vendor names of these tests without their suffixes
VENDOR = {"Acme Ltd": "Acme", "ACME LTD": "ACME", "Acme PLC": "Acme", "Hot Vendor Ltd": "Hot Vendor", "Cold Co": "Cold", "Mid PLC": "Mid"}


def brute_force(rows):
    """Plain-Python pair loop in the rule book's terms; returns {(rid1, rid2): rule}."""
    groups = {}
    for r in rows:
        rid, name, date, amount, inv = r[0], r[1], r[2], r[3], r[4]
        if date is None or amount is None or float(amount) == 0:
            continue
        ts = dt.datetime.fromisoformat(date)
        groups.setdefault(VENDOR.get(name, name or ""), []).append((ts, rid, float(amount),
                                                             "nan" if inv is None else inv.strip()))
    out = {}
    for g in groups.values():
        g.sort()
        for i in range(len(g)):
            for j in range(i + 1, len(g)):
                t1, r1, a1, i1 = g[i]
                t2, r2, a2, i2 = g[j]
                days = math.ceil((t2 - t1).total_seconds() / 86400)
                if days > 30:
                    continue
                pct = abs(a1 - a2) / max(a1, a2)
                if i1 and i1 == i2 and i1 != "nan":
                    out[(r1, r2)] = "DUP-1"
                elif pct < 0.02:
                    if days <= 7:
                        out[(r1, r2)] = "DUP-2"
                    elif not i1 and not i2:
                        out[(r1, r2)] = "DUP-3"
    return out


def run(spark, rows, **kw):
    df = detect_duplicate_payments(ap_frame(spark, rows, **kw))
    return {(r["row_id_1"], r["row_id_2"]): r["rule_id"] for r in df.collect()}


def row(rid, name, date, amount, inv=None):
    return (rid, name, date, amount, inv, "0", "0", "Rent", "B1")


def test_rules_and_boundaries(spark):
    rows = [
        row("a1", "Acme Ltd", "2026-01-01 00:00:00", "1000.00", "INV-1"),
        row("a2", "ACME LTD", "2026-01-20 00:00:00", "5000.00", "INV-1"),        # other case: different vendor
        row("a3", "Acme PLC", "2026-01-25 00:00:00", "7000.00", "INV-1"),        # same invoice, 24 days: DUP-1
        row("b1", "Beta", "2026-02-01 00:00:00", "10000.00", "X1"),
        row("b2", "Beta", "2026-02-07 00:00:00", "10150.00", "X2"),              # 1.48 %, 6 days: DUP-2
        row("b3", "Beta", "2026-02-20 00:00:00", "10100.00", " "),               # 13 days, invoice on b2: none
        row("c1", "Gamma", "2026-03-01 00:00:00", "500.00", " "),
        row("c2", "Gamma", "2026-03-20 00:00:00", "505.00", " "),                # blank invoices, 19 days: DUP-3
        row("c3", "Gamma", "2026-03-25 00:00:00", "505.00", None),               # NULL invoice is 'nan': no DUP-3
        row("d1", "Delta", "2026-04-01 00:00:00", "-100.00", "Q"),
        row("d2", "Delta", "2026-04-03 00:00:00", "-500.00", "R"),               # any two negatives pass
        row("e1", "Eps", "2026-05-01 00:00:00", "100.00", " "),
        row("e2", "Eps", "2026-05-31 22:00:00", "100.00", " "),                  # 30 d 22 h -> 31 days: out
        row("f1", "Zeta", "2026-06-01 00:00:00", "0", "Z"),
        row("f2", "Zeta", "2026-06-02 00:00:00", "0", "Z"),                      # zero amounts skipped
    ]
    got = run(spark, rows)
    assert got == brute_force(rows)
    assert got[("a1", "a3")] == "DUP-1" and got[("b1", "b2")] == "DUP-2"
    assert got[("c1", "c2")] == "DUP-3" and ("c2", "c3") in got and got[("c2", "c3")] == "DUP-2"
    assert got[("d1", "d2")] == "DUP-2" and ("e1", "e2") not in got and ("f1", "f2") not in got


def test_without_invoice_column(spark):
    rows = [row("1", "V", "2026-01-01 00:00:00", "1000.00", "A"), row("2", "V", "2026-01-20 00:00:00", "1001.00", "A")]
    assert run(spark, rows, with_invoice=False) == {("1", "2"): "DUP-3"}


def test_banded_join_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(700):
        vendor = rnd.choice(["Hot Vendor Ltd", "Hot Vendor", "Cold Co", "Mid PLC", None])
        base = dt.datetime(2025, 1, 1) + dt.timedelta(days=rnd.randint(0, 200), hours=rnd.choice([0, 0, 13, 23]))
        amount = rnd.choice([1000, 1010, 1019.99, 1021, 5000, 4900, -40, -400, 0, 99999.99, 100000])
        amount = round(amount * rnd.choice([1, 1, 1.005, 0.99]), 2)
        inv = rnd.choice(["INV-1", "INV-2", " ", "", None, None])
        rows.append(row(f"r{i:04d}", vendor, base.isoformat(sep=" "), f"{amount:.2f}", inv))
    assert run(spark, rows) == brute_force(rows)


def test_equal_rows_pair_up_with_and_without_ids(spark):
    same = [row("1", "V", "2026-01-01 00:00:00", "1000.00", "A")] * 4
    df = ap_frame(spark, same).drop("row_id")
    out = detect_duplicate_payments(df).collect()
    assert len(out) == 6 and len({(r["row_id_1"], r["row_id_2"]) for r in out}) == 6
    assert {r["rule_id"] for r in out} == {"DUP-1"}
    numbered = ap_frame(spark, [row(str(i), *same[0][1:5]) for i in (10, 9, 8)])
    ids = {(r["row_id_1"], r["row_id_2"]) for r in detect_duplicate_payments(numbered.withColumn("row_id", numbered["row_id"].cast("long"))).collect()}
    assert ids == {("8", "9"), ("8", "10"), ("9", "10")}


def test_tier_edges(spark):
    rows = [row(f"{k}{i}", f"V{k}", f"2026-01-0{i} 00:00:00", a, "A") for k, a in enumerate(["1000000", "999999.99", "100000", "99999.99"]) for i in (1, 2)]
    got = {r["vendor_name"]: r["risk_level"] for r in detect_duplicate_payments(ap_frame(spark, rows)).collect()}
    assert got == {"V0": "High", "V1": "Medium", "V2": "Medium", "V3": "Low"}


def test_sides_share_one_exchange(spark, tmp_path):
    """Read back from files, so that the plan is the one of a real table: AP is prepared and exploded once."""
    rows = [(f"r{i}", f"Vendor {i % 5} Ltd", f"2026-01-{1 + i % 28:02d}", f"{100 + i % 7}.00", f"INV{i % 11}", "0", "0", "Rent", "B") for i in range(200)]
    ap_frame(spark, rows).write.parquet(str(tmp_path / "ap"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # 200 rows would be broadcast
    try:
        found = detect_duplicate_payments(spark.read.parquet(str(tmp_path / "ap")))
        assert len(found.collect()) > 0
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan") == 1


def test_only_rows_of_keys_that_meet_are_sent(spark):
    """200 payments of vendors of their own and one pair: the pair's rows, and nothing near all keys."""
    rows = [row(f"r{i}", f"Vendor {i}", "2026-01-05 00:00:00", "1000.00", f"I{i}") for i in range(200)] + [row("z", "Vendor 7", "2026-01-06 00:00:00", "1000.00", "I7")]
    keyed = duplicates._exploded(duplicates._prepare(ap_frame(spark, rows), DEFAULT_RULES), DEFAULT_RULES, lambda r: True)
    sent = duplicates._met(keyed)
    assert {"r7", "z"} <= {r["rid"] for r in sent.collect()}
    assert sent.count() < keyed.count() / 10
