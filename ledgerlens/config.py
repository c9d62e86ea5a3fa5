"""Audit parameters.

``AuditRules`` bundles every threshold a detector reads.  Defaults come from
``fixed_values``; callers override single fields with ``dataclasses.replace``.
The evaluation instant (``asof``) is a separate, required argument of the
detectors that need "now", so results never depend on the wall clock.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from decimal import Decimal

from . import fixed_values as fv


@dataclass(frozen=True)
class AuditRules:
    # names
    name_suffixes: tuple[str, ...] = fv.NAME_SUFFIXES
    name_case_insensitive: bool = False
    name_match_threshold: int = fv.NAME_MATCH_THRESHOLD
    # tax arithmetic
    vat_rate: Decimal = fv.VAT_RATE
    wht_rates: tuple[tuple[str, Decimal], ...] = fv.WHT_RATES
    filing_deadlines: tuple[tuple[str, int | None], ...] = fv.FILING_DEADLINES
    vat_penalty_first_month: int = fv.VAT_LATE_PENALTY_FIRST_MONTH
    vat_penalty_daily: int = fv.VAT_LATE_PENALTY_DAILY
    paye_penalty_first_month: int = fv.PAYE_LATE_PENALTY_FIRST_MONTH
    paye_penalty_daily: int = fv.PAYE_LATE_PENALTY_DAILY
    wht_penalty: int = fv.WHT_LATE_PENALTY
    vat_threshold: int = fv.VAT_THRESHOLD
    paye_bands: tuple[tuple[int, int | None, Decimal], ...] = fv.PAYE_BANDS
    # duplicates
    dup_window_days: int = fv.DUP_WINDOW_DAYS
    dup_near_days: int = fv.DUP_NEAR_DAYS
    dup_amount_tolerance: Decimal = fv.DUP_AMOUNT_TOLERANCE
    dup_high: int = fv.DUP_HIGH
    dup_medium: int = fv.DUP_MEDIUM
    # amount-bin width of the banded duplicate join, in multiples of the tolerance band
    dup_amount_bin_bands: int = 8
    # VAT / WHT
    vat_high: int = fv.VAT_HIGH
    vat_medium: int = fv.VAT_MEDIUM
    vat_penalty_grace_days: int = fv.VAT_PENALTY_GRACE_DAYS
    wht_medium: int = fv.WHT_MEDIUM
    unremitted_high: int = fv.UNREMITTED_HIGH
    # expenses
    exp_spike_factor: int = fv.EXP_SPIKE_FACTOR
    exp_spike_window: int = fv.EXP_SPIKE_WINDOW
    exp_sigma: int = fv.EXP_SIGMA
    exp_min_rows: int = fv.EXP_MIN_ROWS
    exp_round_unit: int = fv.EXP_ROUND_UNIT
    exp_high: int = fv.EXP_HIGH
    # ghosts
    ghost_vendor_high: int = fv.GHOST_VENDOR_HIGH
    ghost_single_payment_min: int = fv.GHOST_SINGLE_PAYMENT_MIN
    ghost_single_payment_medium: int = fv.GHOST_SINGLE_PAYMENT_MEDIUM
    ghost_onboard_days: int = fv.GHOST_ONBOARD_DAYS
    ghost_employee_high: int = fv.GHOST_EMPLOYEE_HIGH
    ghost_no_deduction_min: int = fv.GHOST_NO_DEDUCTION_MIN
    ghost_name_list: int = fv.GHOST_NAME_LIST
    # filing
    filing_at_risk_days: int = fv.FILING_AT_RISK_DAYS
    filing_high_days: int = fv.FILING_HIGH_DAYS
    filing_medium_days: int = fv.FILING_MEDIUM_DAYS
    # report
    severity_critical: int = fv.SEVERITY_CRITICAL
    severity_high: int = fv.SEVERITY_HIGH
    recovery_rate: Decimal = fv.RECOVERY_RATE
    # spellings of dates that are not in ISO order; day before month throughout
    date_formats: tuple[str, ...] = ("yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "d-MMM-yyyy")
    # (column, format): the one format of a column, e.g. ("payment_date", "M/d/yyyy")
    column_formats: tuple[tuple[str, str], ...] = ()
    # (column, "point" or "comma"): the decimal mark of a column of text; a point if not named
    column_marks: tuple[tuple[str, str], ...] = ()


DEFAULT_RULES = AuditRules()


def as_datetime(asof) -> _dt.datetime:
    """Accept a date, datetime or ISO string for the evaluation instant."""
    if isinstance(asof, _dt.datetime):
        return asof.replace(tzinfo=None)
    if isinstance(asof, _dt.date):
        return _dt.datetime(asof.year, asof.month, asof.day)
    return _dt.datetime.fromisoformat(str(asof))
