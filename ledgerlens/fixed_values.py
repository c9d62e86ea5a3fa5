"""Fixed values of the audit rule book.

FIXED VALUES: everything in this module must equal the audited rule book for
results to match (suffix list, tax rates, filing deadlines, penalties, PAYE
bands, detector thresholds, column contracts, column aliases and report text
replacements).  They are listed plainly, in their natural order.  Operators
never hard-code these numbers; they read them through ``AuditRules``.
"""

from __future__ import annotations

from decimal import Decimal

# --- FIXED VALUES: entity names -------------------------------------------
# Business suffixes removed from the end of a name, tested once each, in this
# order (a later suffix is tested against the already shortened name).
NAME_SUFFIXES: tuple[str, ...] = (
    " ltd", " limited", " plc", " inc", " llc",
    " co", " company", " nig", " nigeria", " nig ltd",
    " ent", " enterprises", " ent ltd", " & co", " and co",
    " ltd.", " plc.", " inc.",
)
NAME_MATCH_THRESHOLD = 85

# --- FIXED VALUES: tax rates and thresholds --------------------------------
VAT_RATE = Decimal("0.075")
# Withholding-tax rate by category keyword; the first keyword contained in the
# lower-cased category wins, "default" is the fallback.
WHT_RATES: tuple[tuple[str, Decimal], ...] = (
    ("rent", Decimal("0.10")),
    ("consultancy", Decimal("0.10")),
    ("management", Decimal("0.10")),
    ("contract", Decimal("0.05")),
    ("interest", Decimal("0.10")),
    ("dividend", Decimal("0.10")),
    ("royalty", Decimal("0.10")),
    ("commission", Decimal("0.10")),
    ("default", Decimal("0.05")),
)
# Day of the month following the period on which a filing is due (CIT: none).
FILING_DEADLINES: tuple[tuple[str, int | None], ...] = (
    ("VAT", 21),
    ("PAYE", 10),
    ("WHT", 21),
    ("CIT", None),
)
VAT_LATE_PENALTY_FIRST_MONTH = 25000
VAT_LATE_PENALTY_DAILY = 200
PAYE_LATE_PENALTY_FIRST_MONTH = 25000
PAYE_LATE_PENALTY_DAILY = 2000
WHT_LATE_PENALTY = 25000
VAT_THRESHOLD = 50000
# PAYE bands: (lower bound, upper bound or None for open, rate).
PAYE_BANDS: tuple[tuple[int, int | None, Decimal], ...] = (
    (0, 300000, Decimal("0.07")),
    (300000, 600000, Decimal("0.11")),
    (600000, 1100000, Decimal("0.15")),
    (1100000, 1600000, Decimal("0.19")),
    (1600000, 3200000, Decimal("0.21")),
    (3200000, None, Decimal("0.24")),
)

# --- FIXED VALUES: detector thresholds -------------------------------------
DUP_WINDOW_DAYS = 30
DUP_NEAR_DAYS = 7
DUP_AMOUNT_TOLERANCE = Decimal("0.02")
DUP_HIGH = 1000000
DUP_MEDIUM = 100000

VAT_HIGH = 500000
VAT_MEDIUM = 50000
VAT_PENALTY_GRACE_DAYS = 21
WHT_MEDIUM = 50000
UNREMITTED_HIGH = 500000

EXP_SPIKE_FACTOR = 2
EXP_SPIKE_WINDOW = 3
EXP_SIGMA = 3
EXP_MIN_ROWS = 5
EXP_ROUND_UNIT = 100000
EXP_HIGH = 1000000
EXP_DEFAULT_CATEGORY = "General"
EXP_MISSING_CATEGORY = "Uncategorized"
EXP_CATEGORY_FALLBACKS: tuple[str, ...] = (
    "category", "description", "narration", "particulars", "gl_account",
)

GHOST_VENDOR_HIGH = 500000
GHOST_SINGLE_PAYMENT_MIN = 1000000
GHOST_SINGLE_PAYMENT_MEDIUM = 5000000
GHOST_ONBOARD_DAYS = 7
GHOST_EMPLOYEE_HIGH = 1000000
GHOST_NO_DEDUCTION_MIN = 600000
GHOST_NAME_LIST = 3

FILING_AT_RISK_DAYS = 7
FILING_HIGH_DAYS = 90
FILING_MEDIUM_DAYS = 30

# --- FIXED VALUES: report ---------------------------------------------------
SEVERITY_CRITICAL = 1000000
SEVERITY_HIGH = 100000
RECOVERY_RATE = Decimal("0.8")
TOP_ACTIONS = 3
RECOMMENDED_ACTIONS = 5
PREVIEW_ROWS = 3
CURRENCY_SIGN = "\u20a6"
# Family names, in the order the full scan runs them.
FAMILIES: tuple[str, ...] = ("Duplicates", "VAT/WHT", "Expenses", "Ghost", "Tax Risk")
# Replacements that make report text latin-1 safe, then any other character
# outside latin-1 becomes "?".
TEXT_REPLACEMENTS: tuple[tuple[str, str], ...] = (
    ("\u2014", "-"),    # em dash
    ("\u2013", "-"),    # en dash
    ("\u2018", "'"),    # left single quote
    ("\u2019", "'"),    # right single quote
    ("\u201c", '"'),    # left double quote
    ("\u201d", '"'),    # right double quote
    ("\u20a6", "NGN"),  # naira sign
    ("\u2026", "..."),  # ellipsis
    ("\u00a0", " "),    # no-break space
    ("\u2022", "*"),    # bullet
    ("\u2192", "->"),   # right arrow
    ("\u2190", "<-"),   # left arrow
    ("\u2713", "OK"),   # check mark
    ("\u2717", "X"),    # ballot x
    ("\u2714", "OK"),   # heavy check mark
    ("\u2716", "X"),    # heavy multiplication x
)

# --- FIXED VALUES: input contracts and column aliases ---------------------
EXPECTED_COLUMNS: dict[str, dict[str, tuple[str, ...]]] = {
    "ap": {
        "required": ("transaction_date", "vendor_name", "amount"),
        "optional": ("invoice_number", "payment_method", "payment_date", "vat_amount",
                     "wht_amount", "expense_category", "bank_account"),
    },
    "payroll": {
        "required": ("month", "employee_name", "gross_salary"),
        "optional": ("paye_amount", "pension_amount", "bank_account", "department"),
    },
    "tax_remittance": {
        "required": ("remittance_date", "tax_type", "amount"),
        "optional": ("period_covered", "revenue_agency"),
    },
    "vendor_master": {
        "required": ("vendor_name",),
        "optional": ("vendor_id", "bank_account", "address", "date_added"),
    },
    "employee_master": {
        "required": ("employee_name",),
        "optional": ("employee_id", "bank_account", "date_joined", "status"),
    },
}
# Target column -> source names tried in order; the first present wins.
COLUMN_ALIASES: dict[str, tuple[str, ...]] = {
    "vendor_name": ("vendor", "supplier", "payee", "vendor_name", "name", "beneficiary", "supplier_name"),
    "amount": ("amount", "amount_ngn", "amount_naira", "value", "payment_amount", "total", "sum", "cost", "price"),
    "transaction_date": ("transaction_date", "date", "txn_date", "payment_date", "post_date", "entry_date", "doc_date"),
    "payment_date": ("payment_date", "paid_date", "settlement_date", "disbursement_date"),
    "invoice_number": ("invoice", "invoice_no", "invoice_number", "inv", "ref", "reference", "doc_number",
                       "document_number", "txn_ref"),
    "vat_amount": ("vat", "vat_amount", "value_added_tax", "tax_amount"),
    "wht_amount": ("wht", "wht_amount", "withholding_tax", "withholding"),
    "expense_category": ("category", "expense_category", "gl_account", "account", "description", "narration",
                         "particulars", "expense_type", "cost_center"),
    "bank_account": ("bank_account", "account_number", "bank_acct", "account_no", "account"),
    "employee_name": ("employee", "employee_name", "staff_name", "name", "worker", "personnel"),
    "gross_salary": ("gross_salary", "gross", "gross_pay", "salary", "monthly_salary", "pay", "wage", "emolument"),
    "paye_amount": ("paye", "paye_amount", "tax", "income_tax", "paye_deduction"),
    "pension_amount": ("pension", "pension_amount", "cpf", "pension_contribution"),
    "month": ("month", "period", "pay_period", "salary_month", "pay_month"),
    "department": ("department", "dept", "unit", "division", "cost_center"),
    "remittance_date": ("remittance_date", "date", "payment_date", "remittance"),
    "tax_type": ("tax_type", "type", "tax", "tax_category"),
    "revenue_agency": ("revenue_agency", "agency", "collector", "paid_to"),
    "period_covered": ("period_covered", "period", "tax_period", "month"),
    "vendor_id": ("vendor_id", "id", "vendor_code", "supplier_id", "code"),
    "address": ("address", "location", "addr", "street"),
    "date_added": ("date_added", "created_date", "onboarded", "registration_date", "start_date"),
    "employee_id": ("employee_id", "id", "staff_id", "employee_code", "staff_no"),
    "date_joined": ("date_joined", "hire_date", "start_date", "employment_date"),
    "status": ("status", "active", "employment_status"),
    "payment_method": ("payment_method", "method", "channel", "payment_type", "mode_of_payment"),
}
