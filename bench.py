"""Benchmark: headline audit queries at one scale factor.

Runs each query to completion with the ``noop`` sink (the full plan executes,
nothing is collected to the driver) and prints one JSON line.  Before timing,
the same queries run once over a smaller fixture (BENCH_WARMUP_DIR, sf0.01) so
that JVM class loading, code generation and JIT compilation are not billed to the
first measured query; the timed runs read only the target scale factor.

The given tables are files of one row group each, which Spark reads with one task,
so most of a query's time would be one core's.  Before timing they are written once
to a scratch folder as ``2 * BENCH_CPUS`` files a table (BENCH_SPLIT=0 reads them as
they are; the JSON line says which).  The rows are the same.
Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 1; the best of N runs is reported per query).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans.registry import QUERIES  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.fixtures import VIEWS  # noqa: E402

HEADLINE = [
    "dup4_duplicate_payments",
    "vat6_vat_wht_issues",
    "exp6_overstated_expenses",
    "ghv5_ghost_vendors",
    "ghe5_ghost_employees",
    "txf6_tax_filing_risk",
    "rpt1_full_scan_findings",
    "rpt2_leakage_by_category",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    spark.catalog.clearCache()   # no query reads what an earlier one has kept
    return took


def split_tables(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables that the queries read, as many files each."""
    folder = tempfile.mkdtemp(prefix="ledgerlens-bench-")
    for name in sorted({t for _, tables in VIEWS.values() for t in tables}):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="ledgerlens-bench", memory="16g",
                          extra={"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm):
        for name in names:
            run(spark, name, warm)
    else:
        run(spark, "txf1_observed_months", sf_dir)
    split = os.environ.get("BENCH_SPLIT", "1") != "0"
    source = split_tables(spark, sf_dir, 2 * int(cpus)) if split else sf_dir
    times = {}
    for name in names:
        times[name] = round(min(run(spark, name, source) for _ in range(repeat)), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "audit_suite_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "files_per_table": 2 * int(cpus) if split else "as given"}))
    spark.stop()


if __name__ == "__main__":
    main()
