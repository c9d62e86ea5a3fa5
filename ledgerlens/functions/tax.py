"""Tax arithmetic as Column functions (TAX-1..7).

Money is DECIMAL and rounding is half-up on the exact decimal value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, AuditRules


def _dec(value) -> Column:
    return F.lit(value)


def vat_on(amount: Column, rules: AuditRules = DEFAULT_RULES) -> Column:
    """TAX-1: VAT due on an amount, rounded to cents."""
    return F.round(amount * _dec(rules.vat_rate), 2)


def wht_category(category_lower: Column, rules: AuditRules = DEFAULT_RULES) -> Column:
    """TAX-2: first rate keyword contained in the lower-cased category, else 'default'."""
    out = None
    for keyword, _ in rules.wht_rates:
        cond = category_lower.contains(keyword)
        out = F.when(cond, F.lit(keyword)) if out is None else out.when(cond, F.lit(keyword))
    return out.otherwise(F.lit("default"))


def wht_rate(keyword: Column, rules: AuditRules = DEFAULT_RULES) -> Column:
    """Rate of a keyword picked by ``wht_category``; unknown keywords get the default rate."""
    rates = dict(rules.wht_rates)
    out = None
    for kw, rate in rules.wht_rates:
        cond = keyword == F.lit(kw)
        out = F.when(cond, _dec(rate)) if out is None else out.when(cond, _dec(rate))
    return out.otherwise(_dec(rates["default"]))


def wht_on(amount: Column, category_lower: Column, rules: AuditRules = DEFAULT_RULES) -> Column:
    """TAX-2: withholding tax due on an amount of a given (lower-cased) category."""
    return F.round(amount * wht_rate(wht_category(category_lower, rules), rules), 2)


def paye_on(gross: Column, rules: AuditRules = DEFAULT_RULES) -> Column:
    """TAX-3: progressive PAYE, the closed form of the band loop."""
    g = gross.cast("decimal(20,2)")
    total = None
    for low, high, rate in rules.paye_bands:
        upper = g if high is None else F.least(g, F.lit(high).cast("decimal(20,2)"))
        part = F.greatest(F.lit(0).cast("decimal(20,2)"), upper - F.lit(low)) * _dec(rate)
        total = part if total is None else total + part
    return F.round(total, 2)


def late_penalty(tax_type: Column, days_late: Column, rules: AuditRules = DEFAULT_RULES) -> Column:
    """TAX-4: penalty for a filing ``days_late`` days late."""
    vat = F.when(days_late <= 30, F.lit(rules.vat_penalty_first_month)).otherwise(
        F.lit(rules.vat_penalty_first_month) + (days_late - 30) * F.lit(rules.vat_penalty_daily))
    paye = F.when(days_late <= 30, F.lit(rules.paye_penalty_first_month)).otherwise(
        F.lit(rules.paye_penalty_first_month) + (days_late - 30) * F.lit(rules.paye_penalty_daily))
    return (F.when(tax_type == "VAT", vat)
            .when(tax_type == "PAYE", paye)
            .when(tax_type == "WHT", F.lit(rules.wht_penalty))
            .otherwise(F.lit(rules.vat_penalty_first_month))).cast("bigint")


def should_have_vat(amount: Column, rules: AuditRules = DEFAULT_RULES) -> Column:
    """TAX-5: every exit of the category test returns true, so only the threshold counts."""
    return amount >= F.lit(rules.vat_threshold)


def due_date(period_start: Column, deadline_day: Column) -> Column:
    """TAX-6: day ``deadline_day`` of the month after the period (DATE)."""
    return F.date_add(F.add_months(period_start, 1), deadline_day - 1)


def tier(value: Column, steps: Sequence[tuple[float | int, str]], default: str,
         strict: bool = False) -> Column:
    """TAX-7: first label whose threshold is reached (``>=``, or ``>`` if strict)."""
    out = None
    for threshold, label in steps:
        cond = value > F.lit(threshold) if strict else value >= F.lit(threshold)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)
