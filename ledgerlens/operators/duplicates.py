"""Duplicate payments (DUP-1..4) as one banded self-join.

A plain self-join on the vendor key puts every pair of a vendor's payments
through the residual, which is quadratic for a vendor holding most rows.
Instead every payment is exploded into keys that already encode the band of each
rule, and the exploded frame is joined to itself.  Both sides use the same columns
in the same way, so they are one exchange, which the planner builds once:

* DUP-1 (same invoice): (vendor, invoice, bin of 248 days), rows with an invoice.
* DUP-2 (near amounts within 7 days): (vendor, bin of 16 days, log-amount bin).
* DUP-3 (near amounts within 30 days, blank invoices): (vendor, bin of 62 days,
  log-amount bin), rows with a blank invoice only.

Negative amounts share one amount bin, because any two negatives pass the rule
book's signed ratio test.  A row has one home key per rule; copies for the bin
before and for the amount bins next to an edge meet the home keys of the earlier
payment.  Bins are at least as wide as the rule's band, so each pair meets under
exactly one key.  A key is sent as two 64-bit hashes of (vendor, rule, invoice,
time bin, amount bin) in different orders, so rows of the sort-merge join compare
numbers and not texts; that two keys share both has a probability of 2**-128 a
pair.  Most keys stand in one row alone, or in two that are too far apart: keys are
counted first, without the rows, and only rows of the others are shuffled and sorted.  The exact predicates stay as the join residual, with the (time, row) order
picking one orientation per pair.  A table without row ids is never shuffled whole to number its equal rows: what the
rules read of it is written with a hash of each row, and copies are numbered among the rows of keys that meet.  AQE's skew-join handling splits any bin that
is still hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, AuditRules
from ..functions.dates import DAY_MICROS, day_text, epoch_micros
from ..functions.names import normalize_name, py_str, strip_column
from ..functions.tax import tier
from ..functions.text import naira
from ..session import checkpoint_dir, shuffles_freed, written
from .prepare import MONEY, ap_date_column, empty, money, null_hash, numbered_copies, row_hash, row_order, timestamp

DUP_SCHEMA = T.StructType([
    T.StructField("vendor_name", T.StringType()),
    T.StructField("amount_1", MONEY),
    T.StructField("date_1", T.StringType()),
    T.StructField("amount_2", MONEY),
    T.StructField("date_2", T.StringType()),
    T.StructField("invoice_ref", T.StringType()),
    T.StructField("flagged_amount", MONEY),
    T.StructField("risk_level", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("row_id_1", T.StringType()),
    T.StructField("row_id_2", T.StringType()),
    T.StructField("days_apart", T.LongType()),
])

NEGATIVE_BIN = -(1 << 62)
#: Column of AP that holds the normalised vendor name where a scan has kept it.
NORM = "_vendor_norm"
#: Column that a prepared table without row ids has besides: its ``rid`` is then a hash, which copies share.
NULLS = "nulls"
#: Jobs that write such a table, so that what a job shuffles to make it (joins) is on disk in parts.
SLICES = 3


def _prepare(ap: DataFrame, rules: AuditRules) -> DataFrame | None:
    if "vendor_name" not in ap.columns or "amount" not in ap.columns:
        return None
    dcol = ap_date_column(ap)
    if dcol is None:
        return None
    inv = strip_column(py_str(F.col("invoice_number"))) if "invoice_number" in ap.columns else F.lit("")
    dated = ap.withColumn("_ts", timestamp(ap, dcol, rules))   # named several times below
    ids = [row_order(ap).alias("rid")] if "row_id" in ap.columns else [row_hash(ap).alias("rid"), null_hash(ap).alias(NULLS)]
    return dated.select(
        *ids, F.col("vendor_name").cast("string").alias("name"),
        (F.col(NORM) if NORM in ap.columns else normalize_name("vendor_name", rules)).alias("norm"), 
        epoch_micros(F.col("_ts")).alias("us"), "_ts",
        money(ap, "amount").alias("amt"), inv.alias("inv"),
    ).where(F.col("_ts").isNotNull() & F.col("amt").isNotNull() & (F.col("amt") != 0)).drop("_ts")


INVOICE, WEEK, BLANK = 1, 2, 3


def _band(rules: AuditRules) -> float:
    """How far the logarithms of near amounts can be apart, widened against rounding."""
    return -math.log(1.0 - float(rules.dup_amount_tolerance)) * (1 + 1e-9) + 1e-12


def _amount_bins(rules: AuditRules) -> tuple[Column, Column, Column]:
    """The home bin of an amount, and whether a near amount can be at home in the bin below and above it."""
    band = _band(rules)
    width = band * rules.dup_amount_bin_bands
    positive = F.col("amt") > 0
    la = F.log(F.when(positive, F.col("amt").cast("double")))
    home = F.floor(la / F.lit(width)).cast("bigint")
    at = la - home * F.lit(width)
    return (F.when(positive, home).otherwise(F.lit(NEGATIVE_BIN).cast("bigint")),
            F.coalesce(at < band, F.lit(False)), F.coalesce(at > width - band, F.lit(False)))


#: Widths of a bin of each rule, in windows.  A wide bin spares most copies for the bin before: an invoice is in few
#: rows.  Near amounts may be in many, which all meet each other: two windows compare 1.2 times the pairs that one compares.
WINDOWS = {INVOICE: 8, WEEK: 2, BLANK: 2}


def _width(branch: int, days: int) -> int:
    """Microseconds of a time bin of one rule."""
    return (days + 1) * DAY_MICROS * WINDOWS[branch]


def _places(branch: int, wanted: Column, days: int, unit: int) -> list[Column]:
    """Time bins of one rule as (rule, bin, is it the home bin, units since the bin's start), NULL where a row has none."""
    width = F.lit(_width(branch, days))
    tbin = F.floor(F.col("us") / width).cast("bigint")

    def place(t: Column, home: bool) -> Column:
        return F.struct(F.lit(branch).cast("tinyint").alias("rule"), t.alias("t"), F.lit(home).alias("home_t"),
                        F.floor((F.col("us") - t * width) / F.lit(unit)).alias("since"))
    return [F.when(wanted, place(tbin, True)),
            F.when(wanted & (F.col("us") - tbin * width <= F.lit(days * DAY_MICROS)), place(tbin - 1, False))]


def _exploded(b: DataFrame, rules: AuditRules, on) -> DataFrame:
    """One row per payment and key: (rid, name, us, amt, inv, two hashes, rule, is it the home key, spot).

    Bins are columns before rows are multiplied, first by time and then by amount, so each is computed once a row
    and no key is built by a lambda.  ``spot`` is one number of where the row stands within its key: time, then the
    logarithm of its amount where the rule compares amounts.
    """
    unit = _unit(rules)
    home, low, high = _amount_bins(rules)
    blank, invoiced = F.col("inv") == "", ~F.col("inv").isin("", "nan")
    places = []
    if on("DUP-1"):
        places += _places(INVOICE, invoiced, rules.dup_window_days, unit)
    if on("DUP-2"):
        places += _places(WEEK, F.lit(True), rules.dup_near_days, unit)
    if on("DUP-3"):
        places += _places(BLANK, blank, rules.dup_window_days, unit)
    kept = [c for c in ("rid", NULLS, "name", "us", "amt", "inv") if c in b.columns]
    size = F.when(F.col("amt") > 0, F.floor((F.log(F.col("amt").cast("double")) + 8) * SIZES)).otherwise(F.lit(0).cast("bigint"))
    # vendors as numbers, which are made once a row and not once a key
    vendor = [F.xxhash64("norm").alias("v1"), F.xxhash64(F.lit(1), "norm").alias("v2")]
    binned = b.select(*kept, *vendor, home.alias("bin"), low.alias("low"), high.alias("high"), size.alias("size"))
    timed = binned.select(*kept, "v1", "v2", "bin", "low", "high", "size", F.inline(F.array(*places))).where(F.col("rule").isNotNull())
    by_amount = F.col("rule") != INVOICE

    def amount(a: Column, own: bool) -> Column:
        return F.struct(a.alias("a"), F.lit(own).alias("home_a"))
    amounts = F.array(amount(F.when(by_amount, F.col("bin")).otherwise(F.lit(0).cast("bigint")), True),
                      F.when(by_amount & F.col("low"), amount(F.col("bin") - 1, False)),
                      F.when(by_amount & F.col("high"), amount(F.col("bin") + 1, False)))
    keyed = timed.select(*kept, "v1", "v2", "rule", "t", "home_t", "since", "size", F.inline(amounts)).where(F.col("a").isNotNull())
    inv = F.when(by_amount, F.lit("")).otherwise(F.col("inv"))
    return keyed.select(*kept, F.xxhash64("rule", "v1", inv, "t", "a").alias("k1"), F.xxhash64("a", "t", inv, "v2", -F.col("rule")).alias("k2"),
                        "rule", (F.col("home_t") & F.col("home_a")).alias("home"),
                        (F.col("since") * SPOT + F.when(by_amount, F.col("size")).otherwise(F.lit(0).cast("bigint"))).alias("spot"))


#: Steps of an amount's logarithm in a spot, and what one unit of time counts there.  A spot has 31 bits and a counted
#: key 40, because the keys of all rows are sent: each byte less is one of a dozen.  What they don't tell apart is sent.
SIZES, SPOT, _KEY = 1 << 11, 1 << 18, 1 << 40


def _unit(rules: AuditRules) -> int:
    """Microseconds of a unit of time in a spot: an hour, or more where the windows are years."""
    days = {INVOICE: rules.dup_window_days, WEEK: rules.dup_near_days, BLANK: rules.dup_window_days}
    span = max(_width(k, d) + d * DAY_MICROS for k, d in days.items())
    return max(3_600_000_000, span // (1 << 13) + 1)


#: Most bits of the bitmap of met keys (64 MB), and bits of one of its rows (4 KB).
MOST_BITS, _PART = 1 << 29, 32_768


def _counted(e: DataFrame) -> DataFrame:
    """Per 40 bits of the first hash: rows, whether one is at home, the rule, and the lowest and the highest spot.

    A key is sent with one number, its rule, spot and home bit, and counted where it arrives: most keys stand in one
    row, so counts made where rows are read hold nearly a table of keys per task and spare next to nothing.
    """
    sent = e.select(F.pmod("k1", F.lit(_KEY)).alias("k1"), ((F.col("rule") * F.lit(1 << 32) + F.col("spot")) * 2
                                                            + F.col("home").cast("bigint")).alias("at")).repartition("k1")
    counted = sent.groupBy("k1").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("at").bitwiseAND(F.lit(1).cast("bigint"))).alias("home"),
                                     F.min("at").alias("low"), F.max("at").alias("high"))
    return counted.select("k1", "n", (F.col("home") == 1).alias("home"), F.shiftright("high", 33).alias("rule"),
                          *[F.pmod(F.shiftright(c, 1), F.lit(1 << 32)).alias(c) for c in ("low", "high")])


def _met(e: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """The rows of ``e`` whose key other rows share, and a few others: only these can be in a pair, and only they are sent.

    Keys are counted in a job of their own, by 40 bits of their first hash.  The lowest and the highest spot of a key in two rows
    are those of the two, so such a key is left out if they are too far apart, by a unit more than the rule allows.
    A bitmap of the keys that meet, 64 bits a key within ``MOST_BITS``, goes to the rows; what it lets through
    beyond them finds no partner in the join.
    """
    checkpoint_dir(e.sparkSession)
    time = F.shiftright("high", 18) - F.shiftright("low", 18)
    size = F.abs(F.pmod("high", F.lit(SPOT)) - F.pmod("low", F.lit(SPOT)))
    days = F.when(F.col("rule") == WEEK, rules.dup_near_days).otherwise(rules.dup_window_days)
    apart = (time > F.ceil(days * F.lit(DAY_MICROS / _unit(rules))) + 1) | (size > math.ceil(_band(rules) * SIZES) + 2)
    # 512 numbers of 64 bits a part, the first byte highest
    number = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    with shuffles_freed(e.sparkSession):
        keys = _counted(e).where((F.col("n") > 1) & F.col("home") & ((F.col("n") > 2) | ~apart)).select("k1").checkpoint()
        bits, wanted = _PART, 64 * keys.count()
        while bits < min(wanted, MOST_BITS):
            bits *= 2
        at = keys.select((F.pmod("k1", F.lit(bits)) + 1).alias("at"))
        parts = at.groupBy((F.bitmap_bucket_number("at") - 1).alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        parts = parts.select("part", F.transform(F.sequence(F.lit(0), F.lit(_PART // 64 - 1)), number).alias("words")).checkpoint()
    place = F.pmod("k1", F.lit(bits))
    word = F.get("words", F.shiftright(place.bitwiseAND(F.lit(_PART - 1)), 6).cast("int"))
    shift = F.expr(f"cast(56 - (shiftright(pmod(k1, {bits}), 3) & 7) * 8 + (pmod(k1, {bits}) & 7) as int)")
    is_set = F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return e.join(F.broadcast(parts), F.shiftright(place, 15) == F.col("part")).where(is_set).drop("part", "words", "spot")


def _day(us: Column) -> Column:
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("int"))


def _pairs(b: DataFrame, rules: AuditRules, on, keep: bool = False) -> DataFrame:
    """All rules in one join: qualifying pairs, earlier payment first.

    Every column is read from both sides, so that column pruning leaves the sides
    alike and their exchange is shared.  ``keep``: the rows are written first, for a
    cached ``b``, whose exchange Spark builds once a side.  Rows without ids are
    numbered first: all copies of a row have the same keys, and each key numbers them alike.
    """
    spark = b.sparkSession
    if NULLS not in b.columns:
        e = _met(_exploded(b, rules, on), rules)
        if keep:
            e = written(e)
    else:
        # by the hash of the instant, a condition that reaches the files which most tables are joined from
        instant = F.pmod(F.xxhash64("us"), F.lit(SLICES))
        with shuffles_freed(spark):
            b = written(b, [instant == i for i in range(SLICES)])
        e = _met(_exploded(b, rules, on), rules)
        with shuffles_freed(spark):
            e = written(numbered_copies(e, "rid").drop(NULLS))
    x, y = e.alias("x"), e.alias("y")
    ts1, ts2, r1, r2 = F.col("x.us"), F.col("y.us"), F.col("x.rid"), F.col("y.rid")
    days = F.ceil((ts2 - ts1) / F.lit(float(DAY_MICROS))).cast("bigint")
    a1, a2, i1, i2 = F.col("x.amt"), F.col("y.amt"), F.col("x.inv"), F.col("y.inv")
    tol = F.lit(rules.dup_amount_tolerance)
    close = (((a1 > 0) & (a2 > 0) & (F.abs(a1 - a2) < tol * F.greatest(a1, a2))) | ((a1 < 0) & (a2 < 0)))
    same_invoice = (i1 == i2) & ~i1.isin("", "nan") & ~i2.isin("", "nan")
    near = close & ~same_invoice
    branch = F.greatest(F.col("x.rule"), F.col("y.rule"))   # equal on both sides
    holds = (F.when(branch == INVOICE, same_invoice & (days <= rules.dup_window_days))
             .when(branch == WEEK, near & (days <= rules.dup_near_days))
             .otherwise(near & (days > rules.dup_near_days) & (days <= rules.dup_window_days)))
    earlier = (ts1 < ts2) | ((ts1 == ts2) & (r1 < r2))
    oriented = F.when(earlier, F.col("x.home")).otherwise(F.col("y.home") & earlier)
    same = (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2"))
    rule = F.when(branch == INVOICE, F.lit("DUP-1")).when(branch == WEEK, F.lit("DUP-2")).otherwise(F.lit("DUP-3"))
    name = F.when(earlier, F.col("x.name")).otherwise(F.col("y.name"))
    return x.join(y, same & oriented & holds).select(
        name.alias("name_1"), _day(ts1).alias("day_1"), _day(ts2).alias("day_2"), r1.alias("rid_1"), r2.alias("rid_2"),
        a1.alias("amt_1"), a2.alias("amt_2"), i1.alias("inv_1"), i2.alias("inv_2"), days.alias("days"),
        rule.alias("rule_id"))


def _findings(pairs: DataFrame, rules: AuditRules) -> DataFrame:
    a1, a2 = F.col("amt_1"), F.col("amt_2")
    flagged = F.least(a1, a2)
    inv1, inv2 = F.col("inv_1"), F.col("inv_2")
    details = (F.when(F.col("rule_id") == "DUP-1", F.format_string("Same invoice #%s paid twice", inv1))
               .when(F.col("rule_id") == "DUP-2",
                     F.format_string("Near-identical amounts (%s vs %s) within %d days", naira(a1), naira(a2),
                                     F.col("days")))
               .otherwise(F.format_string("Identical amounts (%s) within %d days, no invoice ref", naira(a1),
                                          F.col("days"))))
    return pairs.select(
        F.col("name_1").alias("vendor_name"), a1.alias("amount_1"), day_text(F.col("day_1")).alias("date_1"),
        a2.alias("amount_2"), day_text(F.col("day_2")).alias("date_2"),
        F.when(inv1 != "nan", inv1).when(inv2 != "nan", inv2).otherwise(F.lit("N/A")).alias("invoice_ref"),
        flagged.alias("flagged_amount"),
        tier(flagged, [(rules.dup_high, "High"), (rules.dup_medium, "Medium")], "Low").alias("risk_level"),
        details.alias("details"), F.col("rule_id"), F.col("rid_1").cast("string").alias("row_id_1"),
        F.col("rid_2").cast("string").alias("row_id_2"), F.col("days").alias("days_apart"))


def detect_duplicate_payments(ap: DataFrame | None, rules: AuditRules = DEFAULT_RULES,
                              include: tuple[str, ...] | None = None, sort: bool = False,
                              keep: bool = False) -> DataFrame | None:
    """DUP-1..4: every qualifying pair once, earlier payment first.

    Rows that are equal in every column are payments of their own: without a
    ``row_id`` they are numbered, so k copies give k * (k - 1) / 2 pairs.
    The keys that payments share are found at once, by jobs; the pairs are lazy.
    ``keep``: the payments that share keys are written to the checkpoint folder; without
    a ``row_id`` they always are, and before them what the rules read of ``ap``.
    """
    if ap is None:
        return None
    b = _prepare(ap, rules)
    if b is None:
        return empty(ap.sparkSession, DUP_SCHEMA)
    on = (lambda r: include is None or r in include)
    if not any(on(r) for r in ("DUP-1", "DUP-2", "DUP-3")):
        return empty(ap.sparkSession, DUP_SCHEMA)
    out = _findings(_pairs(b, rules, on, keep), rules)
    if sort:
        out = out.orderBy(F.col("flagged_amount").desc(), "row_id_1", "row_id_2")
    return out
