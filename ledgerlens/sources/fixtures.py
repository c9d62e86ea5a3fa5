"""Adapter views from the driver's TPC-H-style parquet tables to the five
audit tables (FIXTURES.md section 3).

The view bodies are SQL text with ``{table}`` placeholders.  Spark runs them
through ``spark.sql(text, **dataframes)``, so no global view names are created;
the DuckDB oracle formats the same text with plain table names and puts the
bodies in a ``WITH`` clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import AuditTables

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The evaluation instant the fixtures are checked at.
FIXTURE_ASOF = "2001-12-18 00:00:00"

AP_SQL = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS row_id,
       o_orderdate AS transaction_date,
       l_shipdate AS payment_date,
       CASE WHEN l_orderkey % 701 = 3 AND l_linenumber = 1
            THEN 'Oneoff ' || CAST(l_orderkey AS STRING) || ' & Co Ltd'
            ELSE s_name || CASE l_linenumber % 4 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' PLC' WHEN 2 THEN '' ELSE ' Nig Ltd' END
       END AS vendor_name,
       CAST(CASE WHEN l_quantity = 50 THEN CAST(floor(l_extendedprice / 5000) + 1 AS INT) * 100000
                 WHEN l_orderkey % 211 = 0 AND l_linenumber = 1 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * 200
                 WHEN p_type = 'PROMO' AND year(l_shipdate) = 1998 AND month(l_shipdate) = 6 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * 60
                 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) * 20 END AS DECIMAL(18,2)) AS amount,
       CASE WHEN l_quantity > 5 THEN 'INV-' || CAST(l_orderkey AS STRING) WHEN l_quantity <= 2 THEN ' ' END AS invoice_number,
       CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) * 1.5 END AS DECIMAL(18,2)) AS vat_amount,
       CAST(CASE WHEN l_tax = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS wht_amount,
       CASE p_type WHEN 'STANDARD' THEN 'Rent' WHEN 'ECONOMY' THEN 'Consultancy' WHEN 'MEDIUM' THEN ' Office Supplies'
                   WHEN 'PROMO' THEN 'Contract' WHEN 'SMALL' THEN 'FUEL' END AS expense_category,
       'BA' || CAST(l_suppkey - CASE WHEN l_suppkey % 37 = 1 THEN 1 ELSE 0 END AS STRING) AS bank_account
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

VENDOR_MASTER_SQL = """
SELECT s_name || ' Limited' AS vendor_name, 'V' || CAST(s_suppkey AS STRING) AS vendor_id, 'BA' || CAST(s_suppkey AS STRING) AS bank_account,
       CASE WHEN s_suppkey % 5 = 1 THEN first_paid - INTERVAL '3' DAY ELSE first_paid - INTERVAL '400' DAY END AS date_added
FROM {supplier} JOIN (SELECT l_suppkey, min(l_shipdate) AS first_paid FROM {lineitem} GROUP BY l_suppkey) f ON s_suppkey = l_suppkey
WHERE s_suppkey % 10 <> 0
"""

PAYROLL_SQL = """
SELECT CAST(o_orderkey AS STRING) AS row_id, date_trunc('month', o_orderdate) AS month, c_name AS employee_name,
       CAST(o_totalprice AS DECIMAL(18,2)) AS gross_salary,
       CAST(CASE WHEN c_custkey % 7 = 2 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) * 0.10 END AS DECIMAL(18,2)) AS paye_amount,
       CAST(CASE WHEN c_custkey % 7 IN (2, 3) THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) * 0.08 END AS DECIMAL(18,2)) AS pension_amount,
       'BK' || CAST(c_custkey - CASE WHEN c_custkey % 41 = 1 THEN 1 ELSE 0 END AS STRING) AS bank_account, c_mktsegment AS department
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

EMPLOYEE_MASTER_SQL = """
SELECT c_name AS employee_name, 'E' || CAST(c_custkey AS STRING) AS employee_id FROM {customer} WHERE c_custkey % 10 <> 4
"""

TAX_REMITTANCE_SQL = """
SELECT t.tax_type AS tax_type, mth + INTERVAL '45' DAY AS remittance_date,
       CAST(year(mth) AS STRING) || '-' || lpad(CAST(month(mth) AS STRING), 2, '0') AS period_covered, CAST(100000 AS DECIMAL(18,2)) AS amount
FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS mth FROM {orders}) m
CROSS JOIN (SELECT ' vat ' AS tax_type, 3 AS k UNION ALL SELECT 'WHT' AS tax_type, 4 AS k UNION ALL SELECT 'PAYE' AS tax_type, 5 AS k) t
WHERE month(mth) % t.k <> 0
"""

VIEWS = {
    "ap": (AP_SQL, ("lineitem", "orders", "part", "supplier")),
    "vendor_master": (VENDOR_MASTER_SQL, ("supplier", "lineitem")),
    "payroll": (PAYROLL_SQL, ("orders", "customer")),
    "employee_master": (EMPLOYEE_MASTER_SQL, ("customer",)),
    "tax_remittance": (TAX_REMITTANCE_SQL, ("orders",)),
}


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    text, deps = VIEWS[view]
    frames = {d: read_base(spark, sf_dir, d) for d in deps}
    return spark.sql(text, **frames)


def fixture_tables(spark: SparkSession, sf_dir: str) -> AuditTables:
    """The five audit tables derived from the parquet tables in ``sf_dir``, as lazy plans."""
    return AuditTables(**{v: fixture_view(spark, sf_dir, v) for v in VIEWS})


def oracle_ctes() -> str:
    """``WITH`` clause defining the five audit tables for DuckDB."""
    names = {t: t for t in BASE_TABLES}
    parts = [f"{v} AS ({text.format(**names).strip()})" for v, (text, _) in VIEWS.items()]
    return "WITH " + ",\n".join(parts) + "\n"
