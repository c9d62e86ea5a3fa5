"""The bundle of audit tables a scan runs over."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class AuditTables:
    ap: DataFrame | None = None
    payroll: DataFrame | None = None
    tax_remittance: DataFrame | None = None
    vendor_master: DataFrame | None = None
    employee_master: DataFrame | None = None

    def with_(self, **kw) -> "AuditTables":
        return replace(self, **kw)

    def items(self):
        for name in ("ap", "payroll", "tax_remittance", "vendor_master", "employee_master"):
            yield name, getattr(self, name)
