"""DuckDB oracle SQL, one statement per registered query.

Written directly from the rule book's semantics as plain SQL over the adapter
views (``WITH`` clause from ``sources.fixtures.oracle_ctes``).  Money leaves
as DOUBLE, dates as text, counts as BIGINT, matching the Spark queries.
"""

from __future__ import annotations

from ..fixed_values import NAME_SUFFIXES
from ..sources.fixtures import FIXTURE_ASOF, oracle_ctes

ASOF = f"TIMESTAMP '{FIXTURE_ASOF}'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(expr: str, null_as: str = "''") -> str:
    """NAM-1 in DuckDB: ordered suffix cuts, drop non-word characters, collapse spaces."""
    x = strip(f"coalesce(CAST({expr} AS VARCHAR), {null_as})")
    for suffix in NAME_SUFFIXES:
        pattern = suffix.replace(".", "\\.")
        x = strip(f"regexp_replace({x}, '(?i){pattern}$', '')")
    x = f"regexp_replace({x}, '[^\\pL\\pN_\\s]', '', 'g')"
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def days_floor(start: str, end: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {start}, {end}) / 86400000000.0) AS BIGINT)"


def days_ceil(start: str, end: str) -> str:
    return f"CAST(ceil(date_diff('microsecond', {start}, {end}) / 86400000000.0) AS BIGINT)"


SQL: dict[str, str] = {}


def register(name: str, body: str) -> None:
    SQL[name] = oracle_ctes() + body


# ---------------------------------------------------------------- ghosts
_GHV_P = f"""
, v_p AS (SELECT CAST(vendor_name AS VARCHAR) AS name, {norm('vendor_name')} AS norm, amount AS amt,
               bank_account AS bank, row_id AS rid, payment_date AS ts FROM ap)
, v_stats AS (SELECT norm, arg_min_null(name, rid) AS first_name,
                   arg_min(name, rid) AS first_nonnull_name,
                   arg_min_null(bank, rid) AS first_bank, coalesce(sum(amt), 0) AS total,
                   count(amt) AS cnt, min(ts) AS first_ts, min(rid) AS first_rid
            FROM v_p GROUP BY norm)
, v_master AS (SELECT vendor_name AS mname, {norm('vendor_name')} AS norm, CAST(date_added AS TIMESTAMP) AS added,
                    bank_account AS mbank FROM vendor_master)
, ghv1 AS (SELECT first_name AS name, first_bank AS bank_account, 'Not in vendor master list' AS red_flag_reason,
                  total AS total_paid, CASE WHEN total >= 500000 THEN 'High' ELSE 'Medium' END AS risk_level,
                  'Vendor ''' || first_name || ''' received NGN ' || {money('total')} || ' but is not in the approved vendor master list' AS details,
                  'GHV-1' AS rule_id, 1 AS prio, norm AS ord
           FROM v_stats WHERE norm NOT IN (SELECT norm FROM v_master) AND EXISTS (SELECT 1 FROM vendor_master))
, v_names AS (SELECT bank, name, min(rid) AS first, any_value(norm) AS norm, coalesce(sum(amt), 0) AS sub
            FROM v_p WHERE bank IS NOT NULL AND bank <> '' GROUP BY bank, name)
, v_per_bank AS (SELECT bank, count(DISTINCT norm) AS n, sum(sub) AS total FROM v_names GROUP BY bank
               HAVING count(DISTINCT norm) > 1)
, v_first3 AS (SELECT bank, string_agg(name, ' / ' ORDER BY first, name) AS slash,
                    string_agg(name, ', ' ORDER BY first, name) AS comma
             FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY first, name) AS k
                   FROM v_names WHERE name IS NOT NULL) WHERE k <= 3 GROUP BY bank)
, ghv2 AS (SELECT coalesce(f.slash, '') AS name, b.bank AS bank_account,
                  CAST(b.n AS VARCHAR) || ' vendors sharing same bank account' AS red_flag_reason,
                  b.total AS total_paid, CASE WHEN b.total >= 500000 THEN 'High' ELSE 'Medium' END AS risk_level,
                  'Multiple vendors (' || coalesce(f.comma, '') || ') all pay to bank account ' || b.bank || '. Total: NGN ' || {money('b.total')} AS details,
                  'GHV-2' AS rule_id, 2 AS prio, b.bank AS ord
           FROM v_per_bank b LEFT JOIN v_first3 f ON b.bank = f.bank)
, ghv3 AS (SELECT first_nonnull_name AS name, first_bank AS bank_account,
                  'Single large payment (hit-and-run pattern)' AS red_flag_reason, total AS total_paid,
                  CASE WHEN total >= 5000000 THEN 'Medium' ELSE 'Low' END AS risk_level,
                  'Vendor ''' || first_nonnull_name || ''' received only one payment of NGN ' || {money('total')} || ' — potential ghost vendor' AS details,
                  'GHV-3' AS rule_id, 3 AS prio, norm AS ord
           FROM v_stats WHERE cnt = 1 AND total >= 1000000)
, ghv4 AS (SELECT m.mname AS name, m.mbank AS bank_account, 'Created and paid within same week' AS red_flag_reason,
                  s.total AS total_paid, 'Medium' AS risk_level,
                  'Vendor ''' || m.mname || ''' was added to master list on ' || strftime(m.added, '%Y-%m-%d') ||
                  ' and received first payment within ' || CAST({days_floor('m.added', 's.first_ts')} AS VARCHAR) || ' days' AS details,
                  'GHV-4' AS rule_id, 4 AS prio, m.mname AS ord
           FROM v_master m JOIN v_stats s ON m.norm = s.norm
           WHERE m.added IS NOT NULL AND s.first_ts IS NOT NULL
             AND {days_floor('m.added', 's.first_ts')} BETWEEN 0 AND 7)
"""

_GHOST_COLS = ("name, 'Ghost Vendor' AS type, bank_account, red_flag_reason, CAST(total_paid AS DOUBLE) AS total_paid, "
               "risk_level, details, rule_id")



def _dedup(src: str, cols: str) -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY name, red_flag_reason "
            f"ORDER BY prio, ord) AS k FROM {src}) WHERE k = 1")


for _key, _rule in (("ghv1_not_in_vendor_master", "ghv1"), ("ghv2_shared_vendor_bank", "ghv2"),
                    ("ghv3_single_large_payment", "ghv3"), ("ghv4_created_and_paid", "ghv4")):
    register(_key, _GHV_P + _dedup(_rule, _GHOST_COLS))

register("ghv5_ghost_vendors", _GHV_P + """
, u AS (SELECT * FROM ghv1 UNION ALL SELECT * FROM ghv2 UNION ALL SELECT * FROM ghv3 UNION ALL SELECT * FROM ghv4)
""" + _dedup("u", _GHOST_COLS))

_GHE_P = f"""
, e_p AS (SELECT CAST(employee_name AS VARCHAR) AS name, {norm('employee_name', "'nan'")} AS norm, gross_salary AS amt,
               bank_account AS bank, row_id AS rid,
               (paye_amount IS NULL OR paye_amount = 0) AS no_paye,
               (pension_amount IS NULL OR pension_amount = 0) AS no_pension FROM payroll)
, e_stats AS (SELECT norm, arg_min_null(name, rid) AS first_name, arg_min_null(bank, rid) AS first_bank,
                   coalesce(sum(amt), 0) AS total,
                   count(*) FILTER (WHERE no_paye) AS paye_rows,
                   arg_min_null(name, CASE WHEN no_paye THEN rid END) AS paye_name,
                   arg_min_null(bank, CASE WHEN no_paye THEN rid END) AS paye_bank,
                   coalesce(sum(amt) FILTER (WHERE no_paye), 0) AS paye_total,
                   count(*) FILTER (WHERE no_pension) AS pension_rows,
                   arg_min_null(name, CASE WHEN no_pension THEN rid END) AS pension_name,
                   arg_min_null(bank, CASE WHEN no_pension THEN rid END) AS pension_bank,
                   coalesce(sum(amt) FILTER (WHERE no_pension), 0) AS pension_total
            FROM e_p GROUP BY norm)
, ghe1 AS (SELECT first_name AS name, first_bank AS bank_account, 'Not in employee master list' AS red_flag_reason,
                  total AS total_paid, CASE WHEN total >= 1000000 THEN 'High' ELSE 'Medium' END AS risk_level,
                  'Employee ''' || coalesce(first_name, 'nan') || ''' received NGN ' || {money('total')} || ' in salary but is not in the HR/employee master list' AS details,
                  'GHE-1' AS rule_id, 1 AS prio, norm AS ord
           FROM e_stats
           WHERE norm NOT IN (SELECT {norm('employee_name', "'nan'")} FROM employee_master)
             AND EXISTS (SELECT 1 FROM employee_master))
, e_names AS (SELECT bank, name, min(rid) AS first, any_value(norm) AS norm, coalesce(sum(amt), 0) AS sub
            FROM e_p WHERE bank IS NOT NULL AND bank <> '' GROUP BY bank, name)
, e_per_bank AS (SELECT bank, count(DISTINCT norm) AS n, sum(sub) AS total FROM e_names GROUP BY bank
               HAVING count(DISTINCT norm) > 1)
, e_first3 AS (SELECT bank, string_agg(name, ' / ' ORDER BY first, name) AS slash,
                    string_agg(name, ', ' ORDER BY first, name) AS comma
             FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY first, name) AS k
                   FROM e_names WHERE name IS NOT NULL) WHERE k <= 3 GROUP BY bank)
, ghe2 AS (SELECT coalesce(f.slash, '') AS name, b.bank AS bank_account,
                  CAST(b.n AS VARCHAR) || ' employees sharing same bank account' AS red_flag_reason,
                  b.total AS total_paid, CASE WHEN b.total >= 1000000 THEN 'High' ELSE 'Medium' END AS risk_level,
                  'Multiple employees (' || coalesce(f.comma, '') || ') all receive salary in bank account ' || b.bank || '. Total: NGN ' || {money('b.total')} AS details,
                  'GHE-2' AS rule_id, 2 AS prio, b.bank AS ord
           FROM e_per_bank b LEFT JOIN e_first3 f ON b.bank = f.bank)
, ghe3 AS (SELECT paye_name AS name, paye_bank AS bank_account, 'No PAYE tax deduction' AS red_flag_reason,
                  paye_total AS total_paid, 'Medium' AS risk_level,
                  'Employee ''' || coalesce(paye_name, 'nan') || ''' received NGN ' || {money('paye_total')} || ' salary with no PAYE tax deduction' AS details,
                  'GHE-3' AS rule_id, 3 AS prio, norm AS ord
           FROM e_stats WHERE paye_rows > 0 AND paye_total >= 600000)
, ghe4 AS (SELECT pension_name AS name, pension_bank AS bank_account, 'No pension contribution' AS red_flag_reason,
                  pension_total AS total_paid, 'Low' AS risk_level,
                  'Employee ''' || coalesce(pension_name, 'nan') || ''' received NGN ' || {money('pension_total')} || ' salary with no pension contribution' AS details,
                  'GHE-4' AS rule_id, 4 AS prio, norm AS ord
           FROM e_stats WHERE pension_rows > 0 AND pension_total >= 600000
             AND (pension_name IS NULL OR pension_name NOT IN (
                  SELECT name FROM ghe1 WHERE name IS NOT NULL UNION ALL SELECT name FROM ghe2 WHERE name IS NOT NULL
                  UNION ALL SELECT name FROM ghe3 WHERE name IS NOT NULL)))
"""

_GHE_COLS = _GHOST_COLS.replace("'Ghost Vendor'", "'Ghost Employee'")

for _key, _rule in (("ghe1_not_in_employee_master", "ghe1"), ("ghe2_shared_employee_bank", "ghe2"),
                    ("ghe3_no_paye", "ghe3"), ("ghe4_no_pension", "ghe4")):
    register(_key, _GHE_P + _dedup(_rule, _GHE_COLS))

register("ghe5_ghost_employees", _GHE_P + """
, u AS (SELECT * FROM ghe1 UNION ALL SELECT * FROM ghe2 UNION ALL SELECT * FROM ghe3 UNION ALL SELECT * FROM ghe4)
""" + _dedup("u", _GHE_COLS))

# ---------------------------------------------------------------- VAT / WHT
_WHT_KEYWORDS = (("rent", "0.10"), ("consultancy", "0.10"), ("management", "0.10"), ("contract", "0.05"),
                 ("interest", "0.10"), ("dividend", "0.10"), ("royalty", "0.10"), ("commission", "0.10"),
                 ("default", "0.05"))
_KW_CASE = "CASE " + " ".join(f"WHEN contains(cat, '{k}') THEN '{k}'" for k, _ in _WHT_KEYWORDS) + " ELSE 'default' END"
_RATE_CASE = "CASE kw " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in _WHT_KEYWORDS) + " ELSE 0.05 END"


def _py_text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'nan')"


_REMITTED = f"""
, remitted AS (SELECT DISTINCT upper({strip(_py_text('tax_type'))}) AS tax_type, {strip(_py_text('period_covered'))} AS period
               FROM tax_remittance)
, remitted_ok AS (SELECT * FROM remitted WHERE tax_type <> '' AND period <> '' AND period <> 'nan')
"""

_VAT_B = f"""
, a AS (SELECT row_id, vendor_name AS vendor, {_py_text('vendor_name')} AS vendor_txt, payment_date AS ts, amount AS amt,
               lower({_py_text('expense_category')}) AS cat, vat_amount AS vat, wht_amount AS wht,
               strftime(payment_date, '%Y-%m') AS period, {days_floor('payment_date', ASOF)} AS days
        FROM ap WHERE payment_date IS NOT NULL AND amount > 0)
, w AS (SELECT *, {_KW_CASE} AS kw FROM a)
, w2 AS (SELECT *, round(amt * {_RATE_CASE}, 2) AS exp_wht, round(amt * 0.075, 2) AS exp_vat,
                CASE WHEN days > 21 THEN (CASE WHEN days <= 30 THEN 25000 ELSE 25000 + (days - 30) * 200 END) ELSE 0 END AS vat_pen
         FROM w)
, vat2 AS (SELECT 'VAT Under-deducted' AS issue_type, vendor AS vendor_name, amt AS payment_amount, exp_vat AS expected_tax,
                  'Not deducted' AS remittance_status, exp_vat AS estimated_liability, period,
                  CASE WHEN exp_vat >= 500000 THEN 'High' WHEN exp_vat >= 50000 THEN 'Medium' ELSE 'Low' END AS risk_level,
                  'VAT of ₦' || {money('exp_vat')} || ' should have been deducted on payment of ₦' || {money('amt')} || ' to ' || vendor_txt AS details,
                  'VAT-2' AS rule_id, row_id FROM w2 WHERE amt >= 50000 AND vat = 0)
, vat3(issue_type, vendor_name, payment_amount, expected_tax, remittance_status, estimated_liability, period, risk_level, details, rule_id, row_id) AS (SELECT 'VAT Unremitted', vendor, amt, vat, 'Deducted but not remitted', vat + vat_pen, period,
                  CASE WHEN vat + vat_pen >= 500000 THEN 'High' ELSE 'Medium' END,
                  'VAT of ₦' || {money('vat')} || ' was deducted but not remitted to FIRS for period ' || period || '. Estimated penalty: ₦' || {money('vat_pen')},
                  'VAT-3', row_id FROM w2
           WHERE amt >= 50000 AND vat > 0
             AND NOT EXISTS (SELECT 1 FROM remitted_ok r WHERE r.tax_type = 'VAT' AND r.period = w2.period))
, vat4(issue_type, vendor_name, payment_amount, expected_tax, remittance_status, estimated_liability, period, risk_level, details, rule_id, row_id) AS (SELECT 'WHT Under-deducted', vendor, amt, exp_wht, 'Not deducted', exp_wht, period,
                  CASE WHEN exp_wht >= 50000 THEN 'Medium' ELSE 'Low' END,
                  'WHT of ₦' || {money('exp_wht')} || ' should have been deducted on payment of ₦' || {money('amt')} || ' to ' || vendor_txt || ' (category: ' || kw || ')',
                  'VAT-4', row_id FROM w2 WHERE exp_wht > 0 AND wht = 0)
, vat5(issue_type, vendor_name, payment_amount, expected_tax, remittance_status, estimated_liability, period, risk_level, details, rule_id, row_id) AS (SELECT 'WHT Unremitted', vendor, amt, wht, 'Deducted but not remitted', wht + 25000, period,
                  CASE WHEN wht + 25000 >= 500000 THEN 'High' ELSE 'Medium' END,
                  'WHT of ₦' || {money('wht')} || ' was deducted but not remitted to FIRS for period ' || period || '. Penalty: ₦' || {money('25000')},
                  'WHT-placeholder', row_id FROM w2
           WHERE wht > 0 AND NOT EXISTS (SELECT 1 FROM remitted_ok r WHERE r.tax_type = 'WHT' AND r.period = w2.period))
""".replace("'WHT-placeholder'", "'VAT-5'")
_VAT_P = _REMITTED + _VAT_B

_VAT_COLS = ("issue_type, vendor_name, CAST(payment_amount AS DOUBLE) AS payment_amount, "
             "CAST(expected_tax AS DOUBLE) AS expected_tax, remittance_status, "
             "CAST(estimated_liability AS DOUBLE) AS estimated_liability, period, risk_level, details, rule_id, row_id")

register("vat1_remitted_periods", _REMITTED + "SELECT tax_type, period FROM remitted_ok")
for _key, _rule in (("vat2_vat_under_deducted", "vat2"), ("vat3_vat_unremitted", "vat3"),
                    ("vat4_wht_under_deducted", "vat4"), ("vat5_wht_unremitted", "vat5")):
    register(_key, _VAT_P + f"SELECT {_VAT_COLS} FROM {_rule}")
register("vat6_vat_wht_issues", _VAT_P + f"""
SELECT {_VAT_COLS} FROM (SELECT * FROM vat2 UNION ALL SELECT * FROM vat3 UNION ALL SELECT * FROM vat4
                         UNION ALL SELECT * FROM vat5)""")

# ---------------------------------------------------------------- expenses
_EXP_P = f"""
, e AS (SELECT row_id AS rid, lower({strip("coalesce(CAST(expense_category AS VARCHAR), 'Uncategorized')")}) AS category,
               payment_date AS ts, amount AS amt FROM ap)
, monthly AS (SELECT category, CAST(date_trunc('month', ts) AS DATE) AS month, coalesce(sum(amt), 0) AS monthly_total,
                     count(amt) AS txn_count, avg(amt) AS txn_mean, stddev_samp(amt) AS txn_std
              FROM e WHERE ts IS NOT NULL GROUP BY 1, 2)
, spikes AS (SELECT *, row_number() OVER w AS rn,
                    sum(monthly_total) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prev
             FROM monthly WINDOW w AS (PARTITION BY category ORDER BY month))
, exp3 AS (SELECT category, monthly_total AS transaction_amount, prev / 3 AS baseline_average,
                  (monthly_total * 3 - prev) / prev * 100 AS deviation_pct, strftime(month, '%Y-%m') AS date,
                  CASE WHEN monthly_total >= 1000000 THEN 'High' ELSE 'Medium' END AS risk_level,
                  'EXP-3' AS rule_id, 1 AS prio,
                  'Monthly spend in ''' || category || ''' (NGN ' || {money('monthly_total')} || ') is '
                  || format('{{:.0f}}', CAST((monthly_total * 3 - prev) / prev * 100 AS DOUBLE)) || '% above the 3-month average (NGN '
                  || {money('prev / 3')} || ')' AS details
           FROM spikes WHERE rn > 3 AND prev > 0 AND monthly_total * 3 > prev * 2)
, cstats AS (SELECT category, count(*) AS n, avg(amt) AS mean, stddev_samp(amt) AS std FROM e GROUP BY category)
, exp4(category, transaction_amount, baseline_average, deviation_pct, date, risk_level, rule_id, prio, details) AS (SELECT category, amt, mean, CASE WHEN mean > 0 THEN (amt - mean) / mean * 100 ELSE 0 END,
                  strftime(ts, '%Y-%m-%d'), CASE WHEN amt >= 1000000 THEN 'High' ELSE 'Medium' END, 'EXP-4', 2,
                  'Transaction of NGN ' || {money('amt')} || ' in ''' || category || ''' is ' || format('{{:.1f}}', abs(CAST(amt AS DOUBLE) - mean) / std)
                  || ' standard deviations above normal'
           FROM e JOIN cstats USING (category)
           WHERE n >= 5 AND std IS NOT NULL AND std <> 0 AND amt > mean + 3 * std AND ts IS NOT NULL)
, exp5(category, transaction_amount, baseline_average, deviation_pct, date, risk_level, rule_id, prio, details) AS (SELECT category, amt, mean, 0, coalesce(strftime(ts, '%Y-%m-%d'), 'N/A'), 'Medium', 'EXP-5', 3,
                  'Round-number payment of NGN ' || {money('amt')} || ' in ''' || category || ''' — common fraud pattern (exact multiple of NGN 100,000)'
           FROM e JOIN cstats USING (category) WHERE amt >= 100000 AND amt % 100000 = 0)
"""
_EXP_COLS = ("category, CAST(transaction_amount AS DOUBLE) AS transaction_amount, "
             "round(CAST(baseline_average AS DOUBLE), 2) AS baseline_average, "
             "round(CAST(deviation_pct AS DOUBLE), 2) AS deviation_pct, date, risk_level, details, rule_id")


def _exp_dedup(src: str) -> str:
    return (f"SELECT {_EXP_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY category, transaction_amount, date "
            f"ORDER BY prio) AS k FROM {src}) WHERE k = 1")


register("exp1_category", _EXP_P + "SELECT rid AS row_id, category FROM e")
register("exp2_monthly_spend", _EXP_P + """
SELECT category, strftime(month, '%Y-%m') AS month, CAST(monthly_total AS DOUBLE) AS monthly_total, txn_count,
       round(CAST(txn_mean AS DOUBLE), 2) AS txn_mean, round(txn_std, 2) AS txn_std FROM monthly""")
for _key, _rule in (("exp3_monthly_spike", "exp3"), ("exp4_sigma_outlier", "exp4"), ("exp5_round_number", "exp5")):
    register(_key, _EXP_P + _exp_dedup(_rule))
register("exp6_overstated_expenses", _EXP_P + _exp_dedup(
    "(SELECT * FROM exp3 UNION ALL SELECT * FROM exp4 UNION ALL SELECT * FROM exp5)"))

# ---------------------------------------------------------------- filing
_TXF_P = _REMITTED + f"""
, months AS (SELECT CAST(date_trunc('month', payment_date) AS DATE) AS month FROM ap WHERE payment_date IS NOT NULL
             UNION SELECT CAST(date_trunc('month', month) AS DATE) FROM payroll WHERE month IS NOT NULL
             UNION SELECT CAST(date_trunc('month', remittance_date) AS DATE) FROM tax_remittance
                   WHERE remittance_date IS NOT NULL)
, types AS (SELECT 'VAT' AS tax_type, 21 AS day WHERE EXISTS (SELECT 1 FROM ap)
            UNION ALL SELECT 'WHT', 21 WHERE EXISTS (SELECT 1 FROM ap)
            UNION ALL SELECT 'PAYE', 10 WHERE EXISTS (SELECT 1 FROM payroll))
, grid AS (SELECT m.month, t.tax_type, strftime(m.month, '%Y-%m') AS period,
                  CAST(m.month + INTERVAL 1 MONTH + (t.day - 1) * INTERVAL 1 DAY AS DATE) AS due
           FROM months m, types t)
, open AS (SELECT g.*, {days_floor('CAST(g.due AS TIMESTAMP)', ASOF)} AS d FROM grid g
           WHERE NOT EXISTS (SELECT 1 FROM remitted_ok r WHERE r.tax_type = g.tax_type AND r.period = g.period))
, scored AS (SELECT *, CASE tax_type WHEN 'VAT' THEN (CASE WHEN d <= 30 THEN 25000 ELSE 25000 + (d - 30) * 200 END)
                                     WHEN 'PAYE' THEN (CASE WHEN d <= 30 THEN 25000 ELSE 25000 + (d - 30) * 2000 END)
                                     ELSE 25000 END AS pen
             FROM open WHERE d > -7)
, filing AS (SELECT tax_type, period, strftime(due, '%Y-%m-%d') AS due_date,
                    CASE WHEN d > 0 THEN 'Missed' ELSE 'At Risk' END AS status,
                    CAST(CASE WHEN d > 0 THEN d ELSE 0 END AS BIGINT) AS days_overdue,
                    CAST(CASE WHEN d > 0 THEN pen ELSE 0 END AS BIGINT) AS estimated_penalty,
                    CASE WHEN d > 90 THEN 'High' WHEN d > 30 THEN 'Medium' WHEN d > 0 THEN 'Low' ELSE 'Medium' END AS risk_level,
                    CASE WHEN d > 0 THEN tax_type || ' for ' || period || ' was due on ' || strftime(due, '%Y-%m-%d')
                                         || ' and is now ' || CAST(d AS VARCHAR) || ' days overdue. Estimated penalty: ₦' || {money('pen')}
                         ELSE tax_type || ' for ' || period || ' is due on ' || strftime(due, '%Y-%m-%d') || ' — '
                              || CAST(abs(d) AS VARCHAR) || ' days remaining. File now to avoid penalties.' END AS details
             FROM scored)
"""
register("txf1_observed_months", _TXF_P + "SELECT strftime(month, '%Y-%m') AS month FROM months")
register("txf2_obligations", _TXF_P + "SELECT period, tax_type, strftime(due, '%Y-%m-%d') AS due_date FROM grid")
register("txf3_remitted_periods", _TXF_P + "SELECT tax_type, period FROM remitted_ok")
register("txf4_missed_filings", _TXF_P + "SELECT * FROM filing WHERE status = 'Missed'")
register("txf5_at_risk_filings", _TXF_P + "SELECT * FROM filing WHERE status = 'At Risk'")
register("txf6_tax_filing_risk", _TXF_P + "SELECT * FROM filing")

# ---------------------------------------------------------------- duplicates
_DUP_P = f"""
, d AS (SELECT row_id AS rid, vendor_name AS name, {norm('vendor_name')} AS norm, payment_date AS ts, amount AS amt,
               {strip(_py_text('invoice_number'))} AS inv
        FROM ap WHERE payment_date IS NOT NULL AND amount IS NOT NULL AND amount <> 0)
, pairs AS (SELECT a.name AS name_1, a.amt AS amt_1, a.ts AS ts_1, a.inv AS inv_1, a.rid AS rid_1,
                   b.amt AS amt_2, b.ts AS ts_2, b.inv AS inv_2, b.rid AS rid_2, {days_ceil('a.ts', 'b.ts')} AS days
            FROM d a JOIN d b ON a.norm = b.norm AND (a.ts < b.ts OR (a.ts = b.ts AND a.rid < b.rid))
            WHERE b.ts <= a.ts + INTERVAL 30 DAY)
, classified AS (SELECT *, CASE WHEN inv_1 <> '' AND inv_1 = inv_2 AND inv_1 <> 'nan' THEN 'DUP-1'
                                WHEN abs(amt_1 - amt_2) / greatest(amt_1, amt_2) < 0.02 AND days <= 7 THEN 'DUP-2'
                                WHEN abs(amt_1 - amt_2) / greatest(amt_1, amt_2) < 0.02 AND inv_1 = '' AND inv_2 = '' THEN 'DUP-3'
                           END AS rule_id
                 FROM pairs WHERE days <= 30)
, dups AS (SELECT name_1 AS vendor_name, amt_1 AS amount_1, strftime(ts_1, '%Y-%m-%d') AS date_1,
                  amt_2 AS amount_2, strftime(ts_2, '%Y-%m-%d') AS date_2,
                  CASE WHEN inv_1 <> 'nan' THEN inv_1 WHEN inv_2 <> 'nan' THEN inv_2 ELSE 'N/A' END AS invoice_ref,
                  least(amt_1, amt_2) AS flagged_amount,
                  CASE WHEN least(amt_1, amt_2) >= 1000000 THEN 'High' WHEN least(amt_1, amt_2) >= 100000 THEN 'Medium' ELSE 'Low' END AS risk_level,
                  CASE rule_id WHEN 'DUP-1' THEN 'Same invoice #' || inv_1 || ' paid twice'
                               WHEN 'DUP-2' THEN 'Near-identical amounts (₦' || {money('amt_1')} || ' vs ₦' || {money('amt_2')} || ') within ' || CAST(days AS VARCHAR) || ' days'
                               ELSE 'Identical amounts (₦' || {money('amt_1')} || ') within ' || CAST(days AS VARCHAR) || ' days, no invoice ref' END AS details,
                  rule_id, rid_1 AS row_id_1, rid_2 AS row_id_2, days AS days_apart
           FROM classified WHERE rule_id IS NOT NULL)
"""
_DUP_COLS = ("vendor_name, CAST(amount_1 AS DOUBLE) AS amount_1, date_1, CAST(amount_2 AS DOUBLE) AS amount_2, "
             "date_2, invoice_ref, CAST(flagged_amount AS DOUBLE) AS flagged_amount, risk_level, details, rule_id, "
             "row_id_1, row_id_2, days_apart")
_DUP6 = _DUP_P.replace("\n        FROM ap WHERE", """
        FROM (SELECT ap.* REPLACE (row_id || '#' || c AS row_id)
              FROM ap JOIN (SELECT unnest([1, 2, 3]) AS c) ON c = 1 OR (CAST(amount * 100 AS BIGINT) % 97 = 0 AND invoice_number IS NOT NULL)) ap
        WHERE""")
register("dup6_exact_copies", _DUP6 + "SELECT CAST(least(amount_1, amount_2) AS DOUBLE) AS low_amount, "
         "CAST(greatest(amount_1, amount_2) AS DOUBLE) AS high_amount, date_1, date_2, rule_id, days_apart FROM dups")
register("dup1_same_invoice", _DUP_P + f"SELECT {_DUP_COLS} FROM dups WHERE rule_id = 'DUP-1'")
register("dup2_near_amount_week", _DUP_P + f"SELECT {_DUP_COLS} FROM dups WHERE rule_id = 'DUP-2'")
register("dup3_no_invoice_month", _DUP_P + f"SELECT {_DUP_COLS} FROM dups WHERE rule_id = 'DUP-3'")
register("dup4_duplicate_payments", _DUP_P + f"SELECT {_DUP_COLS} FROM dups")

# ---------------------------------------------------------------- summaries and report
_TXF_B = _TXF_P[len(_REMITTED):]
_TEXT_SWAPS = (("—", "-"), ("–", "-"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'),
               ("₦", "NGN"), ("…", "..."), (" ", " "), ("•", "*"), ("→", "->"),
               ("←", "<-"), ("✓", "OK"), ("✗", "X"), ("✔", "OK"), ("✖", "X"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def clean_text(expr: str) -> str:
    x = f"coalesce(CAST({expr} AS VARCHAR), 'None')"
    for a, b in _TEXT_SWAPS:
        x = f"replace({x}, {_sql_text(a)}, {_sql_text(b)})"
    return f"regexp_replace({x}, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')"


_FINALS = f"""
, ghv_final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, red_flag_reason ORDER BY prio, ord) AS k
                               FROM (SELECT * FROM ghv1 UNION ALL SELECT * FROM ghv2 UNION ALL SELECT * FROM ghv3
                                     UNION ALL SELECT * FROM ghv4)) WHERE k = 1)
, ghe_final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, red_flag_reason ORDER BY prio, ord) AS k
                               FROM (SELECT * FROM ghe1 UNION ALL SELECT * FROM ghe2 UNION ALL SELECT * FROM ghe3
                                     UNION ALL SELECT * FROM ghe4)) WHERE k = 1)
, vat_all AS (SELECT * FROM vat2 UNION ALL SELECT * FROM vat3 UNION ALL SELECT * FROM vat4 UNION ALL SELECT * FROM vat5)
, exp_final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, transaction_amount, date ORDER BY prio) AS k
                               FROM (SELECT * FROM exp3 UNION ALL SELECT * FROM exp4 UNION ALL SELECT * FROM exp5))
                WHERE k = 1)
, ghosts AS (SELECT 0 AS src, name, bank_account, red_flag_reason, total_paid FROM ghv_final
             UNION ALL SELECT 1, name, bank_account, red_flag_reason, total_paid FROM ghe_final)
, t_dup AS (SELECT coalesce(vendor_name, 'nan') AS e, flagged_amount AS a FROM dups
            ORDER BY flagged_amount DESC, row_id_1, row_id_2 LIMIT 1)
, t_vat AS (SELECT issue_type AS e, estimated_liability AS a FROM vat_all ORDER BY estimated_liability DESC, row_id, rule_id LIMIT 1)
, t_exp AS (SELECT category AS e, transaction_amount AS a FROM exp_final
            ORDER BY transaction_amount DESC, category, date LIMIT 1)
, t_gh AS (SELECT coalesce(name, 'nan') AS e, total_paid AS a FROM ghosts
           ORDER BY src, total_paid DESC, name NULLS LAST, red_flag_reason, bank_account NULLS LAST LIMIT 1)
, s_dup AS (SELECT s.n, s.t, CASE WHEN s.n > 0 THEN s.n || ' duplicate payments found. Top: ' || x.e || ' (NGN ' || {money('x.a')} || ')'
                                  ELSE 'No duplicate payments detected.' END AS detail,
                   coalesce(x.e, 'N/A') AS top_e, coalesce(x.a, 0) AS top_a
            FROM (SELECT count(*) AS n, coalesce(sum(flagged_amount), 0) AS t FROM dups) s LEFT JOIN t_dup x ON true)
, s_vat AS (SELECT s.n, s.t, CASE WHEN s.n > 0 THEN s.n || ' VAT/WHT issues found. Top issue: ' || x.e || ' (NGN ' || {money('x.a')} || ')'
                                  ELSE 'No VAT/WHT issues detected.' END AS detail,
                   coalesce(x.e, 'N/A') AS top_e, coalesce(x.a, 0) AS top_a
            FROM (SELECT count(*) AS n, coalesce(sum(estimated_liability), 0) AS t FROM vat_all) s LEFT JOIN t_vat x ON true)
, s_exp AS (SELECT s.n, s.t, CASE WHEN s.n > 0 THEN s.n || ' overstated expense categories. Top: ' || x.e || ' (NGN ' || {money('x.a')} || ')'
                                  ELSE 'No overstated expenses detected.' END AS detail,
                   coalesce(x.e, 'N/A') AS top_e, coalesce(x.a, 0) AS top_a
            FROM (SELECT count(*) AS n, coalesce(sum(transaction_amount), 0) AS t FROM exp_final) s LEFT JOIN t_exp x ON true)
, s_gh AS (SELECT s.n, s.t, CASE WHEN s.n > 0 THEN s.n || ' ghost entities detected. Top: ' || x.e || ' (NGN ' || {money('x.a')} || ')'
                                 ELSE 'No ghost vendors or employees detected' END AS detail,
                  coalesce(x.e, 'N/A') AS top_e, coalesce(x.a, 0) AS top_a
           FROM (SELECT count(*) AS n, coalesce(sum(total_paid), 0) AS t FROM ghosts) s LEFT JOIN t_gh x ON true)
, s_txf AS (SELECT count(*) AS n, coalesce(sum(estimated_penalty), 0) AS t,
                   count(*) FILTER (WHERE status = 'Missed') AS missed, count(*) FILTER (WHERE status = 'At Risk') AS at_risk,
                   coalesce(max(estimated_penalty), 0) AS top_p FROM filing)
, fam AS (SELECT 0 AS ord, 'Duplicates' AS category, CAST(t AS DECIMAL(38,2)) AS amount, n AS items, detail FROM s_dup
          UNION ALL SELECT 1, 'VAT/WHT', t, n, detail FROM s_vat
          UNION ALL SELECT 2, 'Expenses', t, n, detail FROM s_exp
          UNION ALL SELECT 3, 'Ghost', t, n, detail FROM s_gh
          UNION ALL SELECT 4, 'Tax Risk', t, n,
                           CASE WHEN n > 0 THEN n || ' tax filing risks. Missed: ' || missed || ', At risk: ' || at_risk
                                ELSE 'No tax filing risks detected. All filings are on time.' END FROM s_txf)
, findings AS (
    SELECT 'Duplicates' AS category, rule_id AS sub_category, vendor_name AS entity, CAST(flagged_amount AS DECIMAL(38,2)) AS amount,
           risk_level, date_1 AS finding_date, details, 'DUP|' || row_id_1 || '|' || row_id_2 AS finding_id, NULL AS bank_account FROM dups
    UNION ALL SELECT 'VAT/WHT', issue_type, vendor_name, estimated_liability, risk_level, period, details,
           'VAT|' || rule_id || '|' || row_id, NULL FROM vat_all
    UNION ALL SELECT 'Expenses', rule_id, category, transaction_amount, risk_level, date, details,
           'EXP|' || category || '|' || date || '|' || CAST(CAST(transaction_amount AS DECIMAL(38,2)) AS VARCHAR), NULL FROM exp_final
    UNION ALL SELECT 'Ghost', red_flag_reason, name, total_paid, risk_level, NULL, details,
           'GHV|' || red_flag_reason || '|' || coalesce(name, ''), bank_account FROM ghv_final
    UNION ALL SELECT 'Ghost', red_flag_reason, name, total_paid, risk_level, NULL, details,
           'GHE|' || red_flag_reason || '|' || coalesce(name, ''), bank_account FROM ghe_final
    UNION ALL SELECT 'Tax Risk', status, tax_type, estimated_penalty, risk_level, period, details,
           'TXF|' || tax_type || '|' || period, NULL FROM filing)
"""
_ALL = _REMITTED + _VAT_B + _TXF_B + _EXP_P + _GHV_P + _GHE_P + _DUP_P + _FINALS
_SUMMARY_COLS = ("n AS total_flagged, CAST(t AS DOUBLE) AS total_amount, n AS count, top_e AS {top}, "
                 "CAST(top_a AS DOUBLE) AS top_amount, detail")
register("dup5_summary", _ALL + "SELECT " + _SUMMARY_COLS.format(top="top_vendor") + " FROM s_dup")
register("vat7_summary", _ALL + "SELECT " + _SUMMARY_COLS.format(top="top_issue") + " FROM s_vat")
register("exp7_summary", _ALL + "SELECT " + _SUMMARY_COLS.format(top="top_category") + " FROM s_exp")
register("gh6_ghost_summary", _ALL + "SELECT " + _SUMMARY_COLS.format(top="top_entity") + " FROM s_gh")
register("txf7_summary", _ALL + """
SELECT n AS total_flagged, CAST(t AS BIGINT) AS total_amount, n AS count, missed AS missed_count, at_risk AS at_risk_count,
       CAST(top_p AS BIGINT) AS top_penalty,
       CASE WHEN n > 0 THEN n || ' tax filing risks. Missed: ' || missed || ', At risk: ' || at_risk
            ELSE 'No tax filing risks detected. All filings are on time.' END AS detail FROM s_txf""")

FIXTURE_REVENUE = 1000000000000
_TEXTLESS_COLS = ("category, sub_category, entity, CAST(amount AS DOUBLE) AS amount, risk_level, finding_date, "
                  "finding_id")
_UNIFIED_COLS = _TEXTLESS_COLS + ", details"

# clusters of duplicate payments; every payment but a cluster's largest is put on its first finding
_EXPOSURE = """
, e_edges AS (SELECT row_id_1 AS a, row_id_2 AS b FROM dups UNION SELECT row_id_2, row_id_1 FROM dups)
, e_reach AS (SELECT a AS node, a AS reached FROM e_edges UNION SELECT r.node, e.b FROM e_reach r JOIN e_edges e ON e.a = r.reached)
, e_pay AS (SELECT c.cluster, c.node, p.amount, row_number() OVER (PARTITION BY c.cluster ORDER BY p.amount DESC, c.node) AS k
            FROM (SELECT node, min(reached) AS cluster FROM e_reach GROUP BY node) c JOIN ap p ON p.row_id = c.node)
, e_put AS (SELECT row_id_1, row_id_2, sum(amount) AS exposure
            FROM (SELECT p.amount, d.row_id_1, d.row_id_2, row_number() OVER (PARTITION BY p.node ORDER BY d.row_id_1, d.row_id_2) AS n
                  FROM e_pay p JOIN dups d ON p.node = d.row_id_1 OR p.node = d.row_id_2 WHERE p.k > 1) WHERE n = 1 GROUP BY row_id_1, row_id_2)
"""


def _recursive(body: str) -> str:
    ctes = oracle_ctes()
    assert ctes.startswith("WITH ")
    return "WITH RECURSIVE " + ctes[len("WITH "):] + body


SQL["dup7_payment_clusters"] = _recursive(_DUP_P + _EXPOSURE + """
SELECT cluster, count(*) AS payments, CAST(sum(amount) AS DOUBLE) AS total, CAST(max(amount) AS DOUBLE) AS largest,
       CAST(sum(amount) - max(amount) AS DOUBLE) AS exposure FROM e_pay GROUP BY cluster""")
SQL["rpt1_full_scan_findings"] = _recursive(_ALL + _EXPOSURE + f"""
SELECT {_UNIFIED_COLS}, CAST(coalesce(e.exposure, CASE WHEN category = 'Duplicates' THEN 0 END) AS DOUBLE) AS exposure
FROM findings f LEFT JOIN e_put e ON f.finding_id = 'DUP|' || e.row_id_1 || '|' || e.row_id_2""")
register("rpt2_leakage_by_category", _ALL + f"""
SELECT ord, category, CAST(amount AS DOUBLE) AS amount, round(CAST(amount AS DOUBLE) / {FIXTURE_REVENUE} * 100, 1) AS pct_of_revenue
FROM (SELECT ord, category, amount FROM fam UNION ALL SELECT 5, 'Total', sum(amount) FROM fam)""")
register("rpt3_category_metrics", _ALL + """
SELECT ord, category, CAST(amount AS DOUBLE) AS amount, items,
       CASE WHEN amount >= 1000000 THEN 'CRITICAL' WHEN amount >= 100000 THEN 'HIGH' WHEN amount > 0 THEN 'MEDIUM' ELSE 'CLEAN' END AS severity,
       CASE WHEN amount >= 1000000 THEN 'danger' WHEN amount >= 100000 THEN 'warning' ELSE 'success' END AS card,
       CASE WHEN amount >= 1000000 THEN format('{:.1f}', CAST(amount AS DOUBLE) / 1000000) || 'M'
            WHEN amount >= 1000 THEN format('{:.0f}', CAST(amount AS DOUBLE) / 1000) || 'K' ELSE '0' END AS label
FROM fam""")
register("rpt4_leakage_breakdown", _ALL + """
SELECT category, CAST(amount AS DOUBLE) AS amount,
       round(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE) * 100, 1) AS share_pct,
       row_number() OVER (ORDER BY amount DESC, ord) AS rank
FROM fam WHERE amount > 0""")
register("rpt5_findings_summary", _ALL + """
SELECT ord, category, CAST(amount AS DOUBLE) AS amount, items AS items_flagged, detail AS details,
       CAST(CAST(amount * 0.8 AS DECIMAL(38,2)) AS DOUBLE) AS expected_recovery FROM fam""")
register("rpt6_export_manifest", _ALL + """
SELECT * FROM (SELECT 'duplicate_payments' AS sheet, count(*) AS rows FROM dups UNION ALL SELECT 'vat_wht_issues', count(*) FROM vat_all
  UNION ALL SELECT 'overstated_expenses', count(*) FROM exp_final UNION ALL SELECT 'ghost_vendors', count(*) FROM ghv_final
  UNION ALL SELECT 'ghost_employees', count(*) FROM ghe_final UNION ALL SELECT 'tax_filing_risk', count(*) FROM filing) WHERE rows > 0""")
register("rpt7_top_actions", _ALL + """
, acts AS (
    SELECT * FROM (SELECT 'Recover duplicate payment to ' || vendor_name || ' - Invoice ' || invoice_ref AS action,
                          flagged_amount AS amount, 1 AS grp,
                          row_number() OVER (ORDER BY flagged_amount DESC, row_id_1, row_id_2) AS k FROM dups) WHERE k <= 2
    UNION ALL SELECT * FROM (SELECT 'Investigate ghost vendor: ' || name || ' - ' || red_flag_reason AS action,
                          total_paid AS amount, 2 AS grp,
                          row_number() OVER (ORDER BY total_paid DESC, name NULLS LAST, red_flag_reason, bank_account NULLS LAST) AS k
                          FROM ghv_final) WHERE k <= 1
    UNION ALL SELECT * FROM (SELECT 'Remit unremitted ' || issue_type || ' for ' || vendor_name AS action,
                          estimated_liability AS amount, 3 AS grp,
                          row_number() OVER (ORDER BY estimated_liability DESC, row_id, rule_id) AS k FROM vat_all) WHERE k <= 1
    UNION ALL SELECT 'Review all flagged transactions with your finance team', 0, 4, r FROM range(1, 4) t(r))
SELECT row_number() OVER (ORDER BY grp, k) AS rank, action, CAST(amount AS DOUBLE) AS amount
FROM acts ORDER BY grp, k LIMIT 3""")
register("rpt8_recommended_actions", _ALL + """
SELECT ord, category, priority, 'Review and recover ' || items || ' flagged ' || lower(category) || ' items' AS action,
       CAST(amount AS DOUBLE) AS amount, CAST(CAST(amount * 0.8 AS DECIMAL(38,2)) AS DOUBLE) AS recovery,
       CASE priority WHEN 1 THEN 'URGENT' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS priority_label
FROM (SELECT *, CASE WHEN amount >= 1000000 THEN 1 WHEN amount >= 100000 THEN 2 ELSE 3 END AS priority FROM fam
      WHERE amount > 0) ORDER BY priority, ord LIMIT 5""")
register("rpt9_findings_preview", _ALL + f"""
SELECT {_UNIFIED_COLS}, bank_account, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY category, CASE WHEN category = 'Ghost' THEN split_part(finding_id, '|', 1) ELSE '' END
                               ORDER BY CASE WHEN category = 'Tax Risk' THEN sub_category ELSE '' END, amount DESC, finding_id) AS rank
  FROM findings) WHERE rank <= 3""")
register("rpt10_narrative", _ALL + f"""
, tot AS (SELECT sum(amount) AS total, sum(items) AS items FROM fam)
, ranked AS (SELECT *, row_number() OVER (ORDER BY amount DESC, ord) AS r FROM fam WHERE amount > 0)
SELECT 1 AS line, CASE WHEN total > 0 THEN 'This audit of the company for the current period identified total financial leakage of NGN '
                        || {money('total')} || ' across ' || items || ' flagged items.'
                  ELSE 'This audit of the company for the current period found no significant financial leakage. All 5 detection engines returned clean results.' END AS text
FROM tot
UNION ALL SELECT 2, 'Breakdown by category:' FROM tot WHERE total > 0
UNION ALL SELECT r + 2, '- ' || category || ': NGN ' || {money('amount')} || ' (' ||
                 format('{{:,.1f}}', CAST(amount AS DOUBLE) / CAST((SELECT total FROM tot) AS DOUBLE) * 100) || '%)' FROM ranked
UNION ALL SELECT 100, 'The most significant area of concern is ' || category || ', accounting for NGN ' || {money('amount')}
                 || '. Immediate investigation and recovery action is recommended, starting with the highest-value findings.'
          FROM ranked WHERE r = 1
UNION ALL SELECT 101, 'Expected recovery potential: 80% of identified leakage (NGN ' || {money('CAST(total * 0.8 AS DECIMAL(38,2))')} || ').'
          FROM tot WHERE total > 0""")
register("rpt11_clean_text", _ALL + f"""
SELECT {_TEXTLESS_COLS}, {clean_text('details')} AS details FROM findings""")

# ---------------------------------------------------------------- sources, names, tax arithmetic
register("src6_typed_ap_load", """
SELECT row_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, strftime(payment_date, '%Y-%m-%d') AS payment_date,
       vendor_name, CAST(amount AS DOUBLE) AS amount, invoice_number, CAST(vat_amount AS DOUBLE) AS vat_amount,
       CAST(wht_amount AS DOUBLE) AS wht_amount, expense_category, bank_account FROM ap""")
register("src1_csv_round_trip", """
SELECT row_id, vendor_name || ' "Q", x' || chr(10) || 'y' AS vendor_name, CAST(amount AS DOUBLE) AS amount, invoice_number FROM ap""")
register("src3_contract_check", """
SELECT 'ap' AS "table", true AS is_valid, false AS is_valid_cut, 'amount' AS missing, 6 AS optional, count(*) AS rows FROM ap
UNION ALL SELECT 'payroll', true, false, 'gross_salary', 4, count(*) FROM payroll
UNION ALL SELECT 'tax_remittance', true, false, 'amount', 1, count(*) FROM tax_remittance
UNION ALL SELECT 'vendor_master', true, false, 'vendor_name', 3, count(*) FROM vendor_master
UNION ALL SELECT 'employee_master', true, false, 'employee_name', 1, count(*) FROM employee_master""")
register("src10_csv_scan", """
SELECT row_id, vendor_name || ' "Q", x' || chr(10) || 'y' AS vendor_name, CAST(amount AS DOUBLE) AS amount, invoice_number FROM ap""")
_VAT_TEXT = "(amount * 100) % 100 = 0"
# a VAT amount with cents has its decimal mark for sure; whole ones too, as both have two decimals
register("src11_column_formats", f"""
SELECT 'amount' AS column, 'money' AS kind, 0 AS first_votes, count(*) FILTER (WHERE amount <= 2000000) AS second_votes, 0 AS either, 'comma' AS outcome FROM ap
UNION ALL SELECT 'vat_amount', 'money', count(*) FILTER (WHERE NOT {_VAT_TEXT}), count(*) FILTER (WHERE {_VAT_TEXT}), 0, 'ambiguous' FROM ap
UNION ALL SELECT 'wht_amount', 'money', count(wht_amount), 0, 0, 'point' FROM ap
UNION ALL SELECT 'transaction_date', 'date', 0, count(*) FILTER (WHERE day(transaction_date) > 12), count(*) FILTER (WHERE day(transaction_date) <= 12 AND day(transaction_date) <> month(transaction_date)), 'month first' FROM ap
UNION ALL SELECT 'payment_date', 'date', count(*) FILTER (WHERE day(payment_date) > 12), 0, count(*) FILTER (WHERE day(payment_date) <= 12 AND day(payment_date) <> month(payment_date)), 'day first' FROM ap""")
_COMMA_VAT = "replace(replace(replace(format('{:,.2f}', CAST(vat_amount AS DOUBLE)), ',', ';'), '.', ','), ';', '.')"
_REJECTED = f"""
, bad AS (SELECT row_id, 'amount' AS column, 'about 2m' AS raw, 'not a number' AS reason FROM ap WHERE amount > 2000000
  UNION ALL SELECT row_id, 'vat_amount', {_COMMA_VAT}, 'another decimal mark or too large' FROM ap WHERE {_VAT_TEXT}
  UNION ALL SELECT row_id, 'payment_date', '31/02/2026', 'not a date' FROM ap WHERE day(payment_date) = 29)
"""
register("src12_rejected_values", _REJECTED + "SELECT * FROM bad")
register("src13_accepted_rows", _REJECTED + """
SELECT row_id, CAST(amount AS DOUBLE) AS amount, CAST(vat_amount AS DOUBLE) AS vat_amount, CAST(wht_amount AS DOUBLE) AS wht_amount,
       strftime(transaction_date, '%Y-%m-%d') AS transaction_date, strftime(payment_date, '%Y-%m-%d') AS payment_date
FROM ap WHERE row_id NOT IN (SELECT row_id FROM bad)""")
register("src7_coercion", """
SELECT row_id, strftime(transaction_date, '%Y-%m-%d') || ' 00:00:00.000' AS transaction_date,
       strftime(payment_date, '%Y-%m-%d %H:%M:%S') || '.250' AS payment_date,
       strftime(payment_date, '%Y-%m-%d') || ' 00:00:00.000' AS date_added, strftime(payment_date, '%Y-%m-%d') || ' 00:00:00.000' AS date_joined,
       CAST(amount AS DOUBLE) AS amount, CAST(vat_amount AS DOUBLE) AS vat_amount,
       CASE WHEN amount > 1000000 THEN NULL ELSE CAST(wht_amount AS DOUBLE) END AS wht_amount FROM ap""")
register("src6_typed_payroll_load", """
SELECT row_id, strftime(month, '%Y-%m-%d') AS month, employee_name, CAST(gross_salary AS DOUBLE) AS gross_salary,
       CAST(paye_amount AS DOUBLE) AS paye_amount, CAST(pension_amount AS DOUBLE) AS pension_amount, bank_account, department FROM payroll""")
register("src6_typed_tax_load", """
SELECT tax_type, strftime(remittance_date, '%Y-%m-%d') AS remittance_date, period_covered, CAST(amount AS DOUBLE) AS amount FROM tax_remittance""")
register("src6_typed_vendor_master_load", """
SELECT vendor_name, vendor_id, bank_account, strftime(date_added, '%Y-%m-%d') AS date_added FROM vendor_master""")
register("src6_typed_employee_master_load", "SELECT employee_name, employee_id FROM employee_master")
register("src8_ap_profile", f"""
SELECT count(*) AS rows,
       'row_id,transaction_date,payment_date,vendor_name,amount,invoice_number,vat_amount,wht_amount,expense_category,bank_account' AS columns,
       strftime(min(transaction_date), '%Y-%m-%d') AS date_from, strftime(max(transaction_date), '%Y-%m-%d') AS date_to,
       CAST(sum(amount) AS DOUBLE) AS total_amount, '₦' || {money('sum(amount)')} AS total_amount_text FROM ap""")
register("src8_profiles", f"""
, p AS (SELECT 'ap' AS "table", count(*) AS rows,
               'row_id,transaction_date,payment_date,vendor_name,amount,invoice_number,vat_amount,wht_amount,expense_category,bank_account' AS columns,
               min(transaction_date) AS lo, max(transaction_date) AS hi, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total FROM ap
        UNION ALL SELECT 'payroll', count(*), 'row_id,month,employee_name,gross_salary,paye_amount,pension_amount,bank_account,department',
               NULL, NULL, CAST(coalesce(sum(gross_salary), 0) AS DOUBLE) FROM payroll
        UNION ALL SELECT 'tax_remittance', count(*), 'tax_type,remittance_date,period_covered,amount',
               min(remittance_date), max(remittance_date), CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM tax_remittance
        UNION ALL SELECT 'vendor_master', count(*), 'vendor_name,vendor_id,bank_account,date_added', min(date_added), max(date_added), NULL FROM vendor_master
        UNION ALL SELECT 'employee_master', count(*), 'employee_name,employee_id', NULL, NULL, NULL FROM employee_master)
SELECT "table", rows, columns, strftime(lo, '%Y-%m-%d') AS date_from, strftime(hi, '%Y-%m-%d') AS date_to, total AS total_amount,
       '₦' || {money('total')} AS total_amount_text FROM p""")
register("src9_record_counts", """
, c AS (SELECT 'ap' AS "table", count(*) AS rows FROM ap UNION ALL SELECT 'payroll', count(*) FROM payroll
        UNION ALL SELECT 'tax_remittance', count(*) FROM tax_remittance
        UNION ALL SELECT 'vendor_master', count(*) FROM vendor_master
        UNION ALL SELECT 'employee_master', count(*) FROM employee_master)
SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT) FROM c WHERE "table" IN ('ap', 'payroll', 'tax_remittance')""")
register("nam1_normalized_names", f"""
SELECT source, vendor_name, {norm('vendor_name')} AS normalized FROM (
  SELECT DISTINCT 'ap' AS source, vendor_name FROM ap
  UNION SELECT DISTINCT 'vendor_master', vendor_name FROM vendor_master)""")
register("tax1_vat_due", "SELECT row_id, CAST(amount AS DOUBLE) AS amount, CAST(round(amount * 0.075, 2) AS DOUBLE) AS vat_due FROM ap")
register("tax2_wht_due", f"""
, w AS (SELECT row_id, amount, lower(coalesce(expense_category, 'nan')) AS cat FROM ap)
, k AS (SELECT *, {_KW_CASE} AS kw FROM w)
SELECT row_id, CAST(amount AS DOUBLE) AS amount, kw AS wht_category, CAST({_RATE_CASE} AS DOUBLE) AS wht_rate,
       CAST(round(amount * {_RATE_CASE}, 2) AS DOUBLE) AS wht_due FROM k""")
_BANDS = ((0, 300000, "0.07"), (300000, 600000, "0.11"), (600000, 1100000, "0.15"), (1100000, 1600000, "0.19"),
          (1600000, 3200000, "0.21"), (3200000, None, "0.24"))
_PAYE = " + ".join(
    f"greatest(0, {'g' if hi is None else f'least(g, {hi})'} - {lo}) * {rate}" for lo, hi, rate in _BANDS)
register("tax3_paye_annual", f"""
, a AS (SELECT employee_name, year(month) AS year, sum(gross_salary) AS g FROM payroll GROUP BY 1, 2)
SELECT employee_name, year, CAST(g AS DOUBLE) AS annual_gross, CAST(round({_PAYE}, 2) AS DOUBLE) AS paye FROM a""")
register("tax4_late_penalty", _TXF_P + f"""
, late AS (SELECT period, tax_type, {days_floor('CAST(due AS TIMESTAMP)', ASOF)} AS days_late FROM grid)
SELECT period, tax_type, days_late,
       CAST(CASE tax_type WHEN 'VAT' THEN (CASE WHEN days_late <= 30 THEN 25000 ELSE 25000 + (days_late - 30) * 200 END)
                          WHEN 'PAYE' THEN (CASE WHEN days_late <= 30 THEN 25000 ELSE 25000 + (days_late - 30) * 2000 END)
                          ELSE 25000 END AS BIGINT) AS penalty
FROM late WHERE days_late > 0""")
register("tax5_vat_applicable", "SELECT row_id, CAST(amount AS DOUBLE) AS amount, amount >= 50000 AS vat_applicable FROM ap")
register("tax6_filing_due_dates", _TXF_P + "SELECT period, tax_type, strftime(due, '%Y-%m-%d') AS due_date FROM grid")
register("tax7_risk_tiers", _ALL + "SELECT category, risk_level, count(*) AS findings FROM findings GROUP BY 1, 2")


# ---------------------------------------------------------------- name similarity and grouping
def _tokens_sorted(x: str) -> str:
    """Code points 128-255 dropped, non-word characters to spaces, lower case, tokens in order."""
    x = f"regexp_replace({x}, '[\\x{{80}}-\\x{{FF}}]', '', 'g')"
    x = f"lower(regexp_replace({x}, '[^\\pL\\pN_]', ' ', 'g'))"
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


# longest common subsequence, one character of a at a time: a row's new value at j is the largest candidate up
# to j, where a candidate is the diagonal plus one on a match and the value above otherwise
_LCS = """
, lcs AS (
    SELECT DISTINCT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: 0) AS best FROM sides WHERE a <> b AND a <> '' AND b <> ''
    UNION ALL
    SELECT a, b, i + 1, list_prepend(0, list_transform(cand, lambda x, j: list_max(cand[1:j])))
    FROM (SELECT a, b, i, list_transform(range(1, length(b) + 1), lambda j: CASE WHEN a[i + 1] = b[j] THEN best[j] + 1 ELSE best[j + 1] END) AS cand
          FROM lcs WHERE i < length(a)))
, scores AS (SELECT a, b, CAST(round_even(100.0 * 2 * best[-1] / (length(a) + length(b)), 0) AS INTEGER) AS score FROM lcs WHERE i = length(a))
"""


_NAM_PAIRS = f"""
, paid AS (SELECT DISTINCT vendor_name, bank_account FROM ap)
, both_names AS (SELECT p.bank_account, p.vendor_name, m.vendor_name AS master_name,
                        {norm('p.vendor_name')} AS na, {norm('m.vendor_name')} AS nb
                 FROM paid p JOIN vendor_master m ON p.bank_account = m.bank_account)
, keyed AS (SELECT *, {_tokens_sorted('na')} AS a, {_tokens_sorted('nb')} AS b FROM both_names)
, sides AS (SELECT a, b FROM keyed)
""" + _LCS + """
, scored AS (SELECT bank_account, vendor_name, master_name,
                    CASE WHEN na = '' OR nb = '' THEN 0 WHEN k.a = k.b THEN 100 ELSE coalesce(s.score, 0) END AS score
             FROM keyed k LEFT JOIN scores s ON s.a = k.a AND s.b = k.b)
"""
SQL["nam2_similarity_scores"] = _recursive(_NAM_PAIRS + "SELECT bank_account, vendor_name, master_name, score FROM scored")
SQL["nam3_same_vendor"] = _recursive(
    _NAM_PAIRS + "SELECT bank_account, vendor_name, master_name, score >= 85 AS same_vendor FROM scored")

# names in order of first appearance; each joins the earliest leader that it is similar to, or leads
SQL["nam4_vendor_groups"] = _recursive(f"""
, firsts AS (SELECT vendor_name AS name, min(row_id) AS ord, {norm('any_value(vendor_name)')} AS norm FROM ap GROUP BY vendor_name)
, keyed AS (SELECT *, CASE WHEN norm = '' THEN 'empty ' || name ELSE {_tokens_sorted('norm')} END AS key FROM firsts)
, classes AS (SELECT key, arg_min(name, ord) AS rep, arg_min(norm, ord) AS rep_norm, min(ord) AS ord FROM keyed GROUP BY key)
, numbered AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM classes)
, sides AS (SELECT x.key AS a, y.key AS b FROM numbered x JOIN numbered y ON x.k < y.k)
""" + _LCS + """
, alike AS (SELECT y.k, list_sort(list(x.k)) AS earlier FROM scores s JOIN numbered x ON x.key = s.a JOIN numbered y ON y.key = s.b
            WHERE s.score >= 85 AND x.rep_norm <> '' AND y.rep_norm <> '' GROUP BY y.k)
, steps AS (SELECT n.k, coalesce(a.earlier, []) AS earlier FROM numbered n LEFT JOIN alike a ON a.k = n.k)
, led AS (
    SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS leaders
    UNION ALL
    SELECT k, leader, CASE WHEN leader = k THEN list_append(leaders, k) ELSE leaders END
    FROM (SELECT s.k, coalesce(list_filter(s.earlier, lambda x: list_contains(l.leaders, x))[1], s.k) AS leader, l.leaders
          FROM led l JOIN steps s ON s.k = l.k + 1))
SELECT g.rep_norm AS canonical, g.rep AS leader_name, n.name
FROM keyed n JOIN numbered c ON c.key = n.key JOIN led ON led.k = c.k JOIN numbered g ON g.k = led.leader""")
