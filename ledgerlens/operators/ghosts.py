"""Ghost vendors (GHV-1..5) and ghost employees (GHE-1..5).

One pass over the payments per family makes a table by (raw name, bank), which is
written to the checkpoint folder; all rules start from it:

* per name: aggregate again by normalised name, left-join the master rows and
  project every name-keyed rule (not in master, single large payment,
  created-and-paid, no PAYE, no pension) from that one row with an ``inline``
  over an array of candidate findings;
* per bank account: count distinct normalised names per bank.  The first-three
  name list is a row_number <= 3 filter, which Spark plans as a partial
  window-group limit before the shuffle, so no group is ever collected whole.

Skewed keys are absorbed by partial aggregation; "first" values are ``min_by``
on the row-order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, AuditRules
from ..functions.dates import day_text, days_floor
from ..functions.names import normalize_name, py_str
from ..functions.tax import tier
from ..functions.text import described, money as fmt_money
from ..session import written
from .prepare import MONEY, ap_date_column, empty, has, money, order_text, row_order, timestamp

GHOST_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("bank_account", T.StringType()),
    T.StructField("red_flag_reason", T.StringType()),
    T.StructField("total_paid", T.DecimalType(38, 2)),
    T.StructField("risk_level", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("rule_id", T.StringType()),
])

VENDOR = "Ghost Vendor"
EMPLOYEE = "Ghost Employee"
NOT_IN_VENDOR_MASTER = "Not in vendor master list"
NOT_IN_EMPLOYEE_MASTER = "Not in employee master list"
SINGLE_PAYMENT = "Single large payment (hit-and-run pattern)"
CREATED_AND_PAID = "Created and paid within same week"
NO_PAYE = "No PAYE tax deduction"
NO_PENSION = "No pension contribution"


def _finding(name, kind, bank, reason, total, risk, details, rule_id, prio, order, texts) -> list[Column]:
    return [
        name.cast("string").alias("name"), F.lit(kind).alias("type"), bank.cast("string").alias("bank_account"),
        reason.alias("red_flag_reason"), total.cast(T.DecimalType(38, 2)).alias("total_paid"),
        risk.alias("risk_level"), described(texts, details).alias("details"), F.lit(rule_id).alias("rule_id"),
        F.lit(prio).alias("_prio"), order.alias("_order"),
    ]


def _total(c: Column) -> Column:
    """Group total where an all-NULL group sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY))


def _bank_text(df: DataFrame) -> Column:
    return F.col("bank_account").cast("string") if "bank_account" in df.columns else F.lit("N/A")


def _prepare(df: DataFrame, name_col: str, amount_col: str, rules: AuditRules,
             date_col: str | None = None) -> DataFrame:
    extra = []
    for c in ("paye_amount", "pension_amount"):
        if c in df.columns:
            extra.append(money(df, c).alias("_" + c))
    if date_col is not None:
        extra.append(timestamp(df, date_col, rules).alias("_ts"))
    return df.select(
        F.col(name_col).cast("string").alias("_name"),
        money(df, amount_col).alias("_amt"),
        _bank_text(df).alias("_bank"),
        row_order(df).alias("_rid"),
        *extra,
    )


def _name_bank(p: DataFrame, conds: dict[str, Column], rules: AuditRules, null_name: str) -> DataFrame:
    """One row per (raw name, bank): first row, total, count, first date, and the same for the rows of each
    condition in ``conds`` (prefix ``<key>_``).  All rules of a family start from this table; the name
    normaliser runs once per row of it.  The first row is text, so groups are made by sorting: a number comes
    first, which tells rows apart without comparing names."""
    rid = F.col("_rid")
    aggs = [F.min(rid).alias("_r"), _total(F.col("_amt")).alias("_t"), F.count("_amt").alias("_c")]
    if "_ts" in p.columns:
        aggs.append(F.min("_ts").alias("_ts1"))
    for key, cond in conds.items():
        aggs += [F.count_if(cond).alias(f"{key}_n"), F.min(F.when(cond, rid)).alias(f"{key}_r"),
                 _total(F.when(cond, F.col("_amt"))).alias(f"{key}_t")]
    grouped = p.groupBy(F.hash("_name", "_bank").alias("_hash"), "_name", "_bank").agg(*aggs).drop("_hash")
    return grouped.withColumn("_norm", normalize_name("_name", rules, null_as=null_name))


def _per_name(names: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """Per normalised name: first name and bank, total, count, first date, plus the same per condition."""
    aggs = [F.min_by("_name", "_r").alias("_first_name"),
            F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("_r"))).alias("_first_nonnull_name"),
            F.min_by("_bank", "_r").alias("_first_bank"), F.sum("_t").alias("_total"), F.sum("_c").alias("_cnt")]
    if "_ts1" in names.columns:
        aggs.append(F.min("_ts1").alias("_first_ts"))
    for key in conds:
        aggs += [F.sum(f"{key}_n").alias(f"{key}_rows"), F.min_by("_name", f"{key}_r").alias(f"{key}_name"),
                 F.min_by("_bank", f"{key}_r").alias(f"{key}_bank"), F.sum(f"{key}_t").alias(f"{key}_total")]
    return names.groupBy("_norm").agg(*aggs)


def _nonempty(df: DataFrame) -> Column:
    """Scalar subquery: does ``df`` have a row?  (Evaluated once.)"""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("_any")).scalar()


def _struct(name, kind, bank, reason, total, risk, details, rule_id, prio, order, texts) -> Column:
    return F.struct(*_finding(name, kind, bank, reason, total, risk, details, rule_id, prio, order, texts))


def _candidates(j: DataFrame, candidates: list[Column]) -> DataFrame:
    return j.select(F.inline(F.filter(F.array(*candidates), lambda x: x.isNotNull())))


def _shared_bank(names: DataFrame, has_bank: bool, kind: str, noun_plural: str, high: int, rule_id: str,
                 rules: AuditRules, what: str, texts: bool) -> DataFrame | None:
    """GHV-2 / GHE-2: one bank account used by more than one normalised name.

    Blank accounts and missing names are left out after the aggregate and the
    window, not before: a filter on a key would be pushed below the table of names
    and banks, which the other rules share.
    """
    if not has_bank:
        return None
    per_bank = (names.groupBy("_bank")
                .agg(F.count_distinct("_norm").alias("_n"), F.sum("_t").alias("_total"), F.max("_bank").alias("_own"))
                .where((F.col("_n") > 1) & F.col("_own").isNotNull() & (F.col("_own") != "")).drop("_own"))
    w = Window.partitionBy("_bank").orderBy(F.col("_name").isNull(), "_r", "_name")
    first_names = (names.select("_bank", "_name", "_r").withColumn("_k", F.row_number().over(w))
                   .where((F.col("_k") <= rules.ghost_name_list) & F.col("_name").isNotNull())
                   .groupBy("_bank")
                   .agg(F.array_sort(F.collect_list(F.struct("_k", "_name"))).alias("_list")))
    joined = per_bank.join(first_names, "_bank", "left").select(
        "_bank", "_n", "_total",
        F.coalesce(F.transform("_list", lambda s: s["_name"]), F.array().cast("array<string>")).alias("_names"))
    name = F.array_join("_names", " / ")
    reason = F.concat(F.col("_n").cast("string"), F.lit(f" {noun_plural} sharing same bank account"))
    details = F.format_string(f"Multiple {noun_plural} (%s) {what} %s. Total: NGN %s",
                              F.array_join("_names", ", "), F.col("_bank"), fmt_money(F.col("_total")))
    return joined.select(*_finding(
        name, kind, F.col("_bank"), reason, F.col("_total"),
        tier(F.col("_total"), [(high, "High")], "Medium"), details, rule_id, 2, F.col("_bank"), texts))


def _dedupe_sort(parts: list[DataFrame | None], spark, sort: bool = False) -> DataFrame:
    """GHV-5 / GHE-5: union, keep the first row per (name, reason), sort by total."""
    parts = [p for p in parts if p is not None]
    if not parts:
        return empty(spark, GHOST_SCHEMA)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    cols = [f.name for f in GHOST_SCHEMA.fields]
    # drop_duplicates treats NULL names as equal, so they share one key
    kept = (u.groupBy(F.coalesce("name", F.lit("\u0000")).alias("_k1"), "red_flag_reason")
            .agg(F.min_by(F.struct(*cols), F.struct("_prio", "_order")).alias("_r"))
            .select("_r.*"))
    if sort:
        kept = kept.orderBy(F.col("total_paid").desc(), F.col("name").asc_nulls_last(),
                            F.col("red_flag_reason"), F.col("bank_account").asc_nulls_last())
    return kept


def detect_ghost_vendors(ap: DataFrame | None, vendor_master: DataFrame | None = None,
                         rules: AuditRules = DEFAULT_RULES, include: tuple[str, ...] | None = None,
                         sort: bool = False, texts: bool = True) -> DataFrame:
    """GHV-1..5.  ``include`` limits the rules run (e.g. ``("GHV-1",)``).  ``texts=False``: ``details`` is NULL.

    The table of names and banks is made at once, by a job, where rules by name and by bank read it."""
    if ap is None:
        return None
    if "vendor_name" not in ap.columns:
        return empty(ap.sparkSession, GHOST_SCHEMA)
    on = (lambda r: include is None or r in include)
    dcol = ap_date_column(ap)
    names = _name_bank(_prepare(ap, "vendor_name", "amount", rules, date_col=dcol), {}, rules, "")
    parts: list[DataFrame | None] = []
    by_name, by_bank = on("GHV-1") or on("GHV-3") or on("GHV-4"), on("GHV-2") and "bank_account" in ap.columns
    if by_name and by_bank:
        names = written(names)   # the rules read other columns each, so their exchanges would differ
    if by_name:
        parts.append(_vendor_name_rules(_per_name(names, {}), vendor_master, rules, on, dcol is not None, texts))
    if by_bank:
        parts.append(_shared_bank(names, "bank_account" in ap.columns, VENDOR, "vendors", rules.ghost_vendor_high,
                                  "GHV-2", rules, "all pay to bank account", texts))
    return _dedupe_sort(parts, ap.sparkSession, sort)


def _vendor_name_rules(stats: DataFrame, master: DataFrame | None, rules: AuditRules, on, has_dates: bool,
                       texts: bool):
    """GHV-1, GHV-3 and GHV-4 from one per-name row joined to its master rows."""
    use_master = has(master, "vendor_name")
    if use_master:
        has_added = "date_added" in master.columns
        m = master.select(
            normalize_name("vendor_name", rules).alias("_norm"),
            F.col("vendor_name").cast("string").alias("_mname"),
            (timestamp(master, "date_added", rules) if has_added else F.lit(None).cast("timestamp_ntz")).alias("_added"),
            (F.col("bank_account").cast("string") if "bank_account" in master.columns else F.lit("N/A")).alias("_mbank"),
            order_text(master).alias("_morder"), F.lit(True).alias("_in_master"))
        j = stats.join(m, "_norm", "left").withColumn("_master_any", _nonempty(master))
        nonempty = F.col("_master_any")
    else:
        has_added = False
        j = stats.withColumn("_in_master", F.lit(None).cast("boolean"))
        nonempty = F.lit(False)
    total = F.col("_total")
    cands = []
    if on("GHV-1") and use_master:
        details = F.format_string("Vendor '%s' received NGN %s but is not in the approved vendor master list",
                                  py_str(F.col("_first_name")), fmt_money(total))
        cands.append(F.when(nonempty & F.col("_in_master").isNull(), _struct(
            F.col("_first_name"), VENDOR, F.col("_first_bank"), F.lit(NOT_IN_VENDOR_MASTER), total,
            tier(total, [(rules.ghost_vendor_high, "High")], "Medium"), details, "GHV-1", 1, F.col("_norm"), texts)))
    if on("GHV-3"):
        details = F.format_string(
            "Vendor '%s' received only one payment of NGN %s \u2014 potential ghost vendor",
            py_str(F.col("_first_nonnull_name")), fmt_money(total))
        # several master rows repeat this candidate; the (name, reason) dedupe keeps one
        cands.append(F.when((F.col("_cnt") == 1) & (total >= rules.ghost_single_payment_min), _struct(
            F.col("_first_nonnull_name"), VENDOR, F.col("_first_bank"), F.lit(SINGLE_PAYMENT), total,
            tier(total, [(rules.ghost_single_payment_medium, "Medium")], "Low"), details, "GHV-3", 3,
            F.col("_norm"), texts)))
    if on("GHV-4") and has_added and has_dates:
        days = days_floor(F.col("_added"), F.col("_first_ts"))
        details = F.format_string(
            "Vendor '%s' was added to master list on %s and received first payment within %d days",
            py_str(F.col("_mname")), day_text(F.col("_added")), days)
        ok = F.col("_added").isNotNull() & F.col("_first_ts").isNotNull() & days.between(0, rules.ghost_onboard_days)
        cands.append(F.when(ok, _struct(
            F.col("_mname"), VENDOR, F.col("_mbank"), F.lit(CREATED_AND_PAID), total, F.lit("Medium"), details,
            "GHV-4", 4, F.col("_morder"), texts)))
    if not cands:
        return None
    return _candidates(j, cands)


def detect_ghost_employees(payroll: DataFrame | None, employee_master: DataFrame | None = None,
                           rules: AuditRules = DEFAULT_RULES, include: tuple[str, ...] | None = None,
                           sort: bool = False, texts: bool = True) -> DataFrame:
    """GHE-1..5.  A NULL employee name is the text 'nan' before normalising.  ``texts=False``: ``details`` is NULL.

    The table of names and banks is made at once, by a job."""
    if payroll is None:
        return None
    if "employee_name" not in payroll.columns:
        return empty(payroll.sparkSession, GHOST_SCHEMA)
    p = _prepare(payroll, "employee_name", "gross_salary", rules)
    conds = {}
    if "paye_amount" in payroll.columns:
        conds["paye"] = F.col("_paye_amount").isNull() | (F.col("_paye_amount") == 0)
    if "pension_amount" in payroll.columns:
        conds["pension"] = F.col("_pension_amount").isNull() | (F.col("_pension_amount") == 0)
    names = _name_bank(p, conds, rules, "nan")
    if "bank_account" in payroll.columns:
        names = written(names)
    stats = _per_name(names, conds)
    use_master = has(employee_master, "employee_name")
    if use_master:
        norms = (employee_master.select(normalize_name("employee_name", rules, null_as="nan").alias("_norm"))
                 .distinct().withColumn("_in_master", F.lit(True)))
        j = stats.join(norms, "_norm", "left").withColumn("_master_any", _nonempty(employee_master))
        nonempty = F.col("_master_any")
    else:
        j = stats.withColumn("_in_master", F.lit(None).cast("boolean"))
        nonempty = F.lit(False)
    total = F.col("_total")
    g1_fires = nonempty & F.col("_in_master").isNull() if use_master else F.lit(False)
    cands = []
    if use_master:
        details = F.format_string(
            "Employee '%s' received NGN %s in salary but is not in the HR/employee master list",
            py_str(F.col("_first_name")), fmt_money(total))
        cands.append(F.when(g1_fires, _struct(
            F.col("_first_name"), EMPLOYEE, F.col("_first_bank"), F.lit(NOT_IN_EMPLOYEE_MASTER), total,
            tier(total, [(rules.ghost_employee_high, "High")], "Medium"), details, "GHE-1", 1, F.col("_norm"), texts)))
    g3_fires = F.lit(False)
    if "paye" in conds:
        g3_fires = (F.col("paye_rows") > 0) & (F.col("paye_total") >= rules.ghost_no_deduction_min)
        cands.append(F.when(g3_fires, _no_deduction("paye", NO_PAYE, "Medium", "GHE-3", 3,
                                                     "salary with no PAYE tax deduction", texts)))
    if "pension" in conds:
        pname = F.col("pension_name")
        # a name already flagged by GHE-1/GHE-3 for this employee suppresses the
        # pension finding (GHE-2 names are checked after the union)
        same = ((g1_fires & (pname == F.col("_first_name"))) | (g3_fires & (pname == F.col("paye_name"))))
        fires = (F.col("pension_rows") > 0) & (F.col("pension_total") >= rules.ghost_no_deduction_min) \
            & ~F.coalesce(same, F.lit(False))
        cands.append(F.when(fires, _no_deduction("pension", NO_PENSION, "Low", "GHE-4", 4,
                                                  "salary with no pension contribution", texts)))
    parts: list[DataFrame | None] = [
        _candidates(j, cands) if cands else None,
        _shared_bank(names, "bank_account" in payroll.columns, EMPLOYEE, "employees", rules.ghost_employee_high,
                     "GHE-2", rules, "all receive salary in bank account", texts),
    ]
    parts = [x for x in parts if x is not None]
    if not parts:
        return empty(payroll.sparkSession, GHOST_SCHEMA)
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # GHE-4 is dropped when any earlier finding carries the same name
    earlier = F.max(F.when(F.col("rule_id") != "GHE-4", F.lit(1))).over(Window.partitionBy("name"))
    u = (u.withColumn("_earlier", earlier)
         .where((F.col("rule_id") != "GHE-4") | F.col("name").isNull() | F.col("_earlier").isNull())
         .drop("_earlier"))
    if include is not None:
        u = u.where(F.col("rule_id").isin(list(include)))
    return _dedupe_sort([u], payroll.sparkSession, sort)


def _no_deduction(key: str, reason: str, risk: str, rule_id: str, prio: int, what: str,
                  texts: bool) -> Column:
    """GHE-3 / GHE-4: rows with the deduction NULL or 0; per employee total >= threshold."""
    details = F.format_string(f"Employee '%s' received NGN %s {what}", py_str(F.col(f"{key}_name")),
                              fmt_money(F.col(f"{key}_total")))
    return _struct(F.col(f"{key}_name"), EMPLOYEE, F.col(f"{key}_bank"), F.lit(reason), F.col(f"{key}_total"),
                   F.lit(risk), details, rule_id, prio, F.col("_norm"), texts)
