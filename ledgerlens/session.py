"""Session helpers.

Library code never creates a session; it takes the caller's.  ``local_session``
is for tests and the bench.  ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session (the shared folder a cluster names) and only sets one when it
is unset, which happens in local tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "ledgerlens", memory: str = "8g",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.driver.memory", memory)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here gives back its shuffle files when it ends, and not when the driver happens to
    collect its garbage.  For jobs whose result is in files of its own."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, slices: Iterable[Column] = ()) -> DataFrame:
    """``df`` computed once, into compressed files of the checkpoint folder, and read back column by column.

    zstd: the files stay until the session's end, and take a third less than Spark's default leaves.  Its first level
    leaves as much as the usual third one and costs less, and no dictionary is tried on ids, which are all different.
    ``slices``: conditions of which each row meets one; a job each, so that ``shuffles_freed`` frees after each."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
    for part in [df.where(c) for c in slices] or [df]:
        part.write.mode("append").options(**options, **{f"parquet.enable.dictionary#{c}": "false" for c in ("row_id", "rid")}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
