"""ledgerlens: financial-leakage audits as Spark DataFrame operators."""

from .config import DEFAULT_RULES, AuditRules
from .tables import AuditTables

__version__ = "0.1.0"
__all__ = ["AuditRules", "AuditTables", "DEFAULT_RULES"]
