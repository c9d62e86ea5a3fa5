import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, app="ledgerlens-tests", memory="4g",
                      extra={"spark.sql.shuffle.partitions": "4"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-test-ckpt-"))
    yield s


ASOF = "2026-06-30 00:00:00"


def ap_frame(spark, rows, with_invoice=True):
    """AP rows: (row_id, vendor_name, payment_date, amount, invoice_number, vat, wht, category, bank)."""
    cols = ("row_id string, vendor_name string, payment_date string, amount string, invoice_number string, "
            "vat_amount string, wht_amount string, expense_category string, bank_account string")
    df = spark.createDataFrame(rows, cols)
    from ledgerlens.sources.ingest import coerce_types
    df = coerce_types(df.withColumn("transaction_date", df["payment_date"]))
    return df if with_invoice else df.drop("invoice_number")
