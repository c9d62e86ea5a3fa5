"""Overstated expenses (EXP-1..6).

Per-category statistics are one ``groupBy`` (map-side partial aggregation, so
a category holding most rows does not overload a task) joined back to the
payments; Spark broadcasts the per-category table when AQE measures it small
and shuffles otherwise.  The monthly spike rule works on the monthly totals,
one row per (category, month).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, AuditRules
from ..functions.dates import day_text, month_start, month_text
from ..functions.names import strip_column
from ..functions.tax import tier
from ..functions.text import described, money as fmt_money
from ..session import checkpoint_dir
from .prepare import MONEY, ap_date_column, empty, money, order_text, timestamp

EXP_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("transaction_amount", T.DecimalType(38, 2)),
    T.StructField("baseline_average", T.DoubleType()),
    T.StructField("deviation_pct", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("rule_id", T.StringType()),
])


#: Categories whose statistics are sent to every task (about 100 bytes each).
BROADCAST_CATEGORIES = 50_000


def category_column(ap: DataFrame, rules: AuditRules = DEFAULT_RULES):
    """EXP-1: expense_category, else the first fallback column, else a constant;
    NULL becomes 'Uncategorized'; stripped and lower-cased."""
    from ..fixed_values import EXP_CATEGORY_FALLBACKS, EXP_DEFAULT_CATEGORY, EXP_MISSING_CATEGORY
    src = "expense_category" if "expense_category" in ap.columns else next(
        (c for c in EXP_CATEGORY_FALLBACKS if c in ap.columns), None)
    raw = F.col(src).cast("string") if src else F.lit(EXP_DEFAULT_CATEGORY)
    return F.lower(strip_column(F.coalesce(raw, F.lit(EXP_MISSING_CATEGORY))))


def prepared(ap: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame | None:
    dcol = ap_date_column(ap)
    if dcol is None or "amount" not in ap.columns:
        return None
    return ap.select(order_text(ap).alias("_rid"), category_column(ap, rules).alias("category"),
                     timestamp(ap, dcol, rules).alias("_ts"), money(ap, "amount").alias("_amt"))


def monthly_spend(p: DataFrame) -> DataFrame:
    """EXP-2: per (category, month) sum, count, mean and sample std; rows without a date dropped."""
    return _dated(monthly_moments(p))


def monthly_moments(p: DataFrame) -> DataFrame:
    """Per (category, month, NULL for rows without a date): rows, amounts, their sum, the sum of their
    squares in cents (exact; NULL if it has more than 38 digits) and squared deviations.

    This is the one pass over the payments that all statistics come from.
    """
    cents = (F.col("_amt") * 100).cast("decimal(20,0)")
    return (p.groupBy("category", month_start(F.col("_ts")).alias("month"))
            .agg(F.count(F.lit(1)).alias("_rows"), F.count("_amt").alias("txn_count"), F.sum("_amt").alias("_sum"),
                 F.try_sum(cents * cents).alias("_squares"), (F.var_pop("_amt") * F.count("_amt")).alias("_m2")))


def _deviations(n, total, squares, otherwise):
    """Sum of squared deviations of ``n`` amounts from their mean, from their sum and their squares in cents.

    Whole numbers throughout: with m = total div n and r the remainder it is squares - 2 m total + n m^2 - r^2 / n,
    so large means take no digits from small deviations.  ``otherwise``: for sums beyond 38 digits.
    """
    cents = (total * 100).cast("decimal(38,0)")
    m = F.try_divide(cents, n).cast("decimal(38,0)")
    rest = cents - F.try_multiply(m, n.cast("decimal(20,0)"))
    product = F.try_subtract(F.try_multiply(m, n.cast("decimal(20,0)")), F.try_multiply(cents, F.lit(2).cast("decimal(1,0)")))
    exact = F.try_add(squares, F.try_multiply(m, product)).cast("double") - rest.cast("double") * rest.cast("double") / n
    return F.coalesce(exact / 10_000, otherwise)


def _dated(moments: DataFrame) -> DataFrame:
    n = F.col("txn_count")
    m2 = _deviations(n, F.col("_sum"), F.col("_squares"), F.col("_m2"))
    return moments.where(F.col("month").isNotNull()).select(
        "category", "month", F.coalesce("_sum", F.lit(0).cast(MONEY)).alias("monthly_total"), "txn_count",
        F.when(n > 0, F.col("_sum").cast("double") / n).alias("txn_mean"),
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("txn_std"))


def category_stats(moments: DataFrame) -> DataFrame:
    """Rows, mean and sample std per category, merged from the months' moments.

    Where the squares have too many digits, the months are merged pairwise by Chan's
    formula: the deviations within months plus n_i (mean_i - mean)^2 between them.
    """
    n, whole = F.col("txn_count"), Window.partitionBy("category")
    own, mean = F.col("_sum").cast("double") / n, F.sum("_sum").over(whole).cast("double") / F.sum("txn_count").over(whole)
    apart = moments.withColumn("_between", F.when(n > 0, n * (own - mean) * (own - mean)))
    sums = apart.groupBy("category").agg(
        F.sum("_rows").alias("_n"), F.sum(n).alias("_k"), F.sum("_sum").alias("_s"), F.sum("_m2").alias("_within"), F.sum("_between").alias("_apart"),
        F.when(F.count_if(F.col("_squares").isNull() & (n > 0)) == 0, F.try_sum("_squares")).alias("_squares"))
    k = F.col("_k")
    m2 = F.greatest(F.lit(0.0), _deviations(k, F.col("_s"), F.col("_squares"), F.col("_within") + F.col("_apart")))
    return sums.select("category", "_n", F.when(k > 0, F.col("_s").cast("double") / k).alias("_mean"),
                       F.when(k > 1, F.sqrt(m2 / (k - 1))).alias("_std"))


def _with_stats(p: DataFrame, stats: DataFrame) -> DataFrame:
    """Payments joined to their category's statistics.

    The table of categories is counted; up to ``BROADCAST_CATEGORIES`` rows of it
    go to every task, so that payments are not shuffled on their few categories.
    A larger one is joined by a shuffle, whose skewed partitions Spark splits.
    """
    small = stats.count() <= BROADCAST_CATEGORIES
    return p.join(F.broadcast(stats) if small else stats, "category", "inner")


def _row(category, amount, baseline, deviation, date, risk, details, rule_id, prio, order):
    return [category.alias("category"), amount.cast(T.DecimalType(38, 2)).alias("transaction_amount"),
            baseline.cast("double").alias("baseline_average"), deviation.cast("double").alias("deviation_pct"),
            date.alias("date"), risk.alias("risk_level"), details.alias("details"), F.lit(rule_id).alias("rule_id"),
            F.lit(prio).alias("_prio"), order.cast("string").alias("_order")]


def detect_overstated_expenses(ap: DataFrame | None, rules: AuditRules = DEFAULT_RULES,
                               include: tuple[str, ...] | None = None, sort: bool = False,
                               texts: bool = True) -> DataFrame | None:
    """EXP-3..6 over AP; ``include`` limits the rules, dedupe and sort are EXP-6.

    One job runs here: the table of categories and months is computed and written to
    the checkpoint folder.  ``texts=False``: ``details`` is NULL."""
    if ap is None:
        return None
    p = prepared(ap, rules)
    if p is None:
        return empty(ap.sparkSession, EXP_SCHEMA)
    on = (lambda r: include is None or r in include)
    parts = []
    checkpoint_dir(ap.sparkSession)
    moments = monthly_moments(p).checkpoint()   # one row per category and month
    if on("EXP-3"):
        parts.append(_spikes(moments, rules, texts))
    if on("EXP-4") or on("EXP-5"):
        parts.append(_payment_rules(p, category_stats(moments), rules, on("EXP-4"), on("EXP-5"), texts))
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    cols = [f.name for f in EXP_SCHEMA.fields]
    kept = (u.groupBy("category", "transaction_amount", "date")
            .agg(F.min_by(F.struct(*cols), F.struct("_prio", "_order")).alias("_r"))
            .select("_r.*"))
    if sort:
        kept = kept.orderBy(F.col("transaction_amount").desc(), "category", "date")
    return kept


def _spikes(moments: DataFrame, rules: AuditRules, texts: bool) -> DataFrame:
    """EXP-3: month total above ``factor`` x the mean of the previous three observed months."""
    k = rules.exp_spike_window
    w = Window.partitionBy("category").orderBy("month")
    m = (_dated(moments)
         .withColumn("_rn", F.row_number().over(w))
         .withColumn("_prev", F.sum("monthly_total").over(w.rowsBetween(-k, -1))))
    total, prev = F.col("monthly_total"), F.col("_prev")
    hit = m.where((F.col("_rn") > k) & (prev > 0) & (total * k > prev * rules.exp_spike_factor))
    rolling = prev / F.lit(k)
    deviation = (total * k - prev) / prev * 100
    details = F.format_string(
        "Monthly spend in '%s' (NGN %s) is %s%% above the 3-month average (NGN %s)",
        F.col("category"), fmt_money(total), F.format_string("%.0f", deviation.cast("double")),
        fmt_money(rolling.cast("double")))
    return hit.select(*_row(F.col("category"), total, rolling, deviation, month_text(F.col("month")),
                            tier(total, [(rules.exp_high, "High")], "Medium"), described(texts, details), "EXP-3", 1,
                            F.col("month").cast("string")))


def _is_multiple(amount: Column, unit: int) -> Column:
    """Is ``amount`` (``MONEY``) at least ``unit`` and a multiple of it?  By whole numbers: a decimal
    remainder is computed by big integers of any length."""
    whole = amount.cast("bigint")
    return (amount >= unit) & (whole % F.lit(unit).cast("bigint") == 0) & (whole.cast(MONEY) == amount)


def _payment_rules(p: DataFrame, stats: DataFrame, rules: AuditRules, outliers: bool, rounds: bool,
                   texts: bool) -> DataFrame:
    """EXP-4 and EXP-5 in one pass over the payments joined to their category statistics.

    EXP-4: amount above mean + 3 sample std of its category (>= 5 rows, std > 0), dated.
    EXP-5: non-zero amounts that are a multiple of the round unit and at least one unit.
    """
    unit = rules.exp_round_unit
    is_round = _is_multiple(F.col("_amt"), unit)
    j = _with_stats(p if outliers else p.where(is_round), stats)
    amt = F.col("_amt").cast("double")
    mean = F.col("_mean").cast("double")
    cands, hits = [], []
    if outliers:
        hit = ((F.col("_n") >= rules.exp_min_rows) & F.col("_std").isNotNull() & (F.col("_std") != 0)
               & (amt > mean + rules.exp_sigma * F.col("_std")) & F.col("_ts").isNotNull())
        deviation = F.when(mean > 0, (amt - mean) / mean * 100).otherwise(F.lit(0.0))
        hits.append(hit)
        details = F.format_string(
            "Transaction of NGN %s in '%s' is %s standard deviations above normal",
            fmt_money(F.col("_amt")), F.col("category"),
            F.format_string("%.1f", F.abs(amt - mean) / F.col("_std")))
        cands.append(F.when(hit, F.struct(*_row(
            F.col("category"), F.col("_amt"), mean, deviation, day_text(F.col("_ts")),
            tier(F.col("_amt"), [(rules.exp_high, "High")], "Medium"), described(texts, details), "EXP-4", 2, F.col("_rid")))))
    if rounds:
        hits.append(is_round)
        details = F.format_string(
            "Round-number payment of NGN %s in '%s' \u2014 common fraud pattern (exact multiple of NGN %s)",
            fmt_money(F.col("_amt")), F.col("category"), F.format_number(F.lit(unit), 0))
        cands.append(F.when(is_round, F.struct(*_row(
            F.col("category"), F.col("_amt"), F.coalesce(mean, F.lit(0.0)), F.lit(0.0),
            F.coalesce(day_text(F.col("_ts")), F.lit("N/A")), F.lit("Medium"), described(texts, details), "EXP-5", 3,
            F.col("_rid")))))
    found = j.where(reduce(Column.__or__, hits))   # few payments: the others build no finding
    return found.select(F.inline(F.filter(F.array(*cands), lambda x: x.isNotNull())))
