"""CSV with line breaks in quoted fields, read by many tasks (SRC-1).

Spark's reader of such files gives a whole file to one task, because a split can't
know whether it begins inside quotes.  Here lines are read as text, so files are
split as usual, and three steps make records of them:

1. every split counts its quotes; odd or even is all that is kept;
2. over a file's splits in order, the exclusive prefix XOR of these tells which
   splits begin inside quotes (one row per split; only those that do are kept);
3. every split cuts its lines at breaks outside quotes.  What it holds of a record
   that began earlier or goes on behind it are fragments, at most two per split,
   which are put together by file and place.

A quote inside a quoted field is doubled, as spreadsheets write it, so quotes
toggle.  A file with single quotes inside unquoted fields (``5" pipe``) is not of
this kind and needs the whole-file reader.
"""

from __future__ import annotations

import csv
import io
import sys as _sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Python workers may not have this package on their path (the driver can run
# from any folder), so functions of this module travel to them by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

WHOLE, HEAD, TAIL = 0, 1, 2
#: Lines of the longest header.
HEADER_LINES = 100


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines that begin in each split; a line keeps its carriage return."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def split_states(lines: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return odd.withColumn("inside", inside).where("inside").select("file", "block")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, inside, value) come split by split, in order; gives (file, block, kind, record)."""
    names = ["file", "block", "kind", "record"]
    at, held, kind, inside = None, [], WHOLE, False
    out: list[tuple] = []

    def end(closed: bool) -> None:
        if held:
            out.append((*at, kind if closed or kind == HEAD else TAIL, "\n".join(held)))

    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        begins, quotes = batch.column(2).to_pylist(), pc.count_substring(batch.column(3), '"').to_pylist()
        for file, block, begin, n, line in zip(files, blocks, begins, quotes, batch.column(3).to_pylist()):
            if (file, block) != at:
                end(not inside)
                at, held, inside = (file, block), [], begin
                kind = HEAD if begin else WHOLE
            elif not inside:
                end(True)
                held, kind = [], WHOLE
            held.append(line)
            inside ^= bool(n & 1)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=names)
            out.clear()
    end(not inside)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=names)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, record): one row per CSV record, without its line end; block: the split that it begins in."""
    lines = _lines(spark, path)
    # one row per split that begins inside quotes: fewer than one in 128 MB of input
    states = F.broadcast(split_states(lines).withColumn("inside", F.lit(True)))
    marked = lines.join(states, ["file", "block"], "left").select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    cut = marked.mapInArrow(_cut, "file string, block bigint, kind int, record string")
    whole = cut.where(F.col("kind") == WHOLE).select("file", "block", "record")
    # in order of place, each tail begins a record, and the heads up to the next one go on with it
    order = Window.partitionBy("file").orderBy("block", "kind")
    parts = cut.where(F.col("kind") != WHOLE).withColumn("n", F.count_if(F.col("kind") == TAIL).over(order))
    joined = parts.groupBy("file", "n").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"))
    joined = joined.select("file", "block", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    # as Spark's reader does: where lines end in \r\n, one inside quotes is a \n too
    clean = F.when(F.endswith("record", F.lit("\r")), F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    return whole.unionByName(joined).select("file", "block", clean.alias("record")).where("record <> ''")


def first_record(spark: SparkSession, path: str) -> str | None:
    """The header: the first record of the first file by name."""
    lines = _lines(spark, path).where(F.col("block") == 0)
    name = lines.agg(F.min("file")).first()[0]
    if name is None:
        return None
    out, quotes = [], 0
    for row in spark.read.text(name, lineSep="\n").limit(HEADER_LINES).collect():   # a limit reads the file's first lines
        out.append(row["value"])
        quotes += row["value"].count('"')
        if quotes % 2 == 0:
            break
    return "\n".join(out).removesuffix("\r")


def column_names(line: str) -> list[str]:
    """Names in a header; blank and repeated ones get their place, as Spark's reader does."""
    names = next(csv.reader(io.StringIO(line.lstrip("\ufeff"), newline="")))
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv_splits(spark: SparkSession, path: str, options: dict) -> DataFrame | None:
    """All columns as text, as the whole-file reader gives them; None if there is no line."""
    line = first_record(spark, path)
    if line is None:
        return None
    ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in column_names(line))
    rows = records(spark, path).where((F.col("block") != 0) | (F.col("record") != F.lit(line)))
    return rows.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
