"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Sizes are words.  The sources' targets share the size of the whole table by
weight, each held to ``MOST_REPEATS`` times its source's size, the excess going
to the others by weight.  The total is cut into blocks of equal size, and blocks
are seats: they go to the sources with the highest quotients target / (2k + 1),
and each source's blocks go to its shards in the same way by the shards' sizes.
A shard lays its documents end to end in seeded order and takes its quota as
whole rounds and one run of blocks that starts at a seeded block and goes round.
A document's share of that run follows from its place, so no row per block is made.

Seats are given without running through them: rounding target / divisor gives
almost all of them, and the few that are then missing go to the highest of the
next quotients, of which each source offers only as many as it can still win.

Null text: size 0.  Null source: a source of its own, the last one.  Null ids,
repeated rows and rows sharing an id: rows of their own.  Columns other than
doc_id, source and text are ignored, whatever their names.  An empty table gives
an empty result; if all sizes are 0, so are all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20_240_501
DOCUMENTS_PER_SHARD = 16_384
#: Blocks that the smallest target has at least, and the largest block.
LEAST_BLOCKS, LARGEST_BLOCK = 64, 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size) per row, written once so that texts are read once."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    return materialize(out.withColumn("row", F.monotonically_increasing_id()))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, documents, target) from one row per source.

    Sources are ordered by the ratio at which they reach their cap.  Those below
    the level that the rest settles at take their cap, the others weight * level.
    The windows hold one row per source.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, -1)
    out = sources.withColumn("place", F.row_number().over(place))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = out.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_REPEATS)).withColumn("reach", F.col("cap") / F.col("weight"))
    out = out.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    capped, free = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if this source and all that reach their cap later are free
    out = out.withColumn("level", (F.col("total") - capped) / free)
    settled = F.min(F.when(F.col("reach") >= F.col("level"), F.struct("reach", "place", "level"))).over(everything)
    out = out.withColumn("level", F.coalesce(settled["level"], F.lit(0.0)))
    return out.select("source", "source_size", "documents", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def apportioned(rows: DataFrame, group: list[str], name: str, size: str, seats: str) -> DataFrame:
    """``rows`` with ``quota``: the seats of each row of a group by Sainte-Lague.

    ``size``: what the quotients are of; ``seats``: the seats of the group (equal
    on its rows); ``name``: breaks ties.  With divisor total / seats rounding is
    off by at most half a seat per row, so a row can still win or lose at most
    1 + its share of half the rows; that many quotients are offered.
    """
    of_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    out = rows.withColumn("__total", F.sum(size).over(of_group)).withColumn("__rows", F.count("*").over(of_group))
    fair = F.when(F.col("__total") > 0, F.col(size) * F.col(seats) / F.col("__total")).otherwise(F.lit(0.0))
    out = out.withColumn("__reach", (F.ceil(1 + F.try_divide(F.col(size), F.col("__total")) * F.col("__rows") / 2)).cast("long"))
    out = out.withColumn("__reach", F.coalesce("__reach", F.lit(1).cast("long"))).withColumn("__sure", F.greatest(F.round(fair).cast("long") - F.col("__reach"), F.lit(0).cast("long")))
    out = out.withColumn("__left", F.col(seats) - F.sum("__sure").over(of_group))
    offers = out.withColumn("__k", F.explode(F.sequence(F.col("__sure"), F.col("__sure") + 2 * F.col("__reach"))))
    best = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    best = best.orderBy(F.desc(F.col(size) / (2 * F.col("__k") + 1)), F.col(name).isNull(), name, "__k")
    offers = offers.withColumn("__rank", F.row_number().over(best))
    won = F.sum(((F.col("__rank") <= F.col("__left")) & (F.col(size) > 0)).cast("long"))
    keys = [c for c in rows.columns]
    return offers.groupBy(*keys).agg((F.max("__sure") + won).alias("quota"))


def _class(doc_id: str, size: str, seed: int) -> Column:
    """Where a document stands in its shard; rows that share doc_id and size stand together."""
    return F.struct(F.xxhash64(doc_id, F.lit(seed + 1)).alias("order"), F.col(doc_id).isNotNull().alias("named"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(size).alias("size"))


def _shard(doc_id: str, size: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, size, F.lit(seed)), F.col("shards"))


def _placed(docs: DataFrame, weights: tuple[int, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their place in their shard (begin, end) and the shard's run; and the sources with their number of shards."""
    rows = sized(docs)
    of_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), weights)
    everything = Window.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(LARGEST_BLOCK), F.floor(smallest / LEAST_BLOCKS))), F.lit(1)).cast("long")
    of_source = of_source.withColumn("block", block).withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    of_source = apportioned(of_source, [], "source", "target", "seats").withColumnRenamed("quota", "source_blocks")
    of_source = materialize(of_source.withColumn("shards", F.ceil(F.col("documents") / DOCUMENTS_PER_SHARD)))

    named = of_source.withColumnRenamed("source", "of_source")
    rows = rows.join(named, rows["source"].eqNullSafe(named["of_source"])).drop("of_source")
    rows = rows.withColumn("shard", _shard("doc_id", "size", seed)).withColumn("class", _class("doc_id", "size", seed))
    per_shard = rows.groupBy("source", "shard", "block", "source_blocks").agg(F.sum("size").cast("double").alias("shard_size"))
    per_shard = apportioned(per_shard, ["source"], "shard", "shard_size", "source_blocks")
    quota = F.least(F.col("quota") * F.col("block"), F.col("shard_size").cast("long") * MOST_REPEATS)
    shard_size = F.col("shard_size").cast("long")
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.greatest(F.ceil(shard_size / F.col("block")), F.lit(1))) * F.col("block")
    per_shard = per_shard.select(
        F.col("source").alias("of_source"), F.col("shard").alias("of_shard"), shard_size.alias("shard_size"), start.alias("start"),
        F.when(shard_size > 0, F.floor(quota / shard_size)).otherwise(F.lit(0)).alias("rounds"),
        F.when(shard_size > 0, F.pmod(quota, shard_size)).otherwise(F.lit(0)).alias("run"))
    rows = rows.join(per_shard, rows["source"].eqNullSafe(per_shard["of_source"]) & (rows["shard"] == per_shard["of_shard"]))
    laid = Window.partitionBy("source", "shard").orderBy("class", "row").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(laid), F.lit(0).cast("long"))
    rows = rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size"))
    # the run covers [start, start + run) and, where that passes the end, [0, start + run - shard_size)
    straight = F.greatest(F.lit(0), F.least("end", F.col("start") + F.col("run")) - F.greatest("begin", "start"))
    beyond = F.greatest(F.lit(0), F.least(F.col("end"), F.col("start") + F.col("run") - F.col("shard_size")) - F.col("begin"))
    run_start = F.when(straight > 0, F.greatest(F.col("start") - F.col("begin"), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("taken", F.col("rounds") * F.col("size") + straight + beyond).withColumn("run_start", run_start.cast("long"))
    return rows.withColumn("run_words", (straight + beyond).cast("long")).withColumn("rounds", F.col("rounds").cast("long")), of_source.select("source", "shards")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken, rounds, run_start, run_words) per row of ``docs``.

    taken: words the mix takes, repeats counted, at most three times the size: ``rounds``
    whole copies and ``run_words`` words from word ``run_start`` on (going round).
    """
    return _placed(docs, weights, seed)[0].select("row", "doc_id", "source", "size", "source_size", "target", "taken", "rounds", "run_start", "run_words")


def _cuts(placed: DataFrame) -> DataFrame:
    """One row per shard of which something is taken: where its run begins and ends.

    first, last: the classes that hold the first word of the run and the first one
    behind it; wraps: the run goes round the shard's end.  For both classes the
    number of their rows, and run_start and run_words, which are those of the class
    if it has one row.
    """
    behind = F.pmod(F.col("start") + F.col("run"), F.col("shard_size"))
    holds = lambda at: (F.col("begin") <= at) & (at < F.col("end"))
    first, last = F.when(holds(F.col("start")), F.col("class")), F.when(holds(behind), F.col("class"))
    cuts = placed.where("shard_size > 0").groupBy("source", "shard").agg(
        F.first("rounds").alias("rounds"), F.first("run").alias("run"), F.max(F.col("start") + F.col("run") >= F.col("shard_size")).alias("wraps"),
        F.max(first).alias("first"), F.max(last).alias("last"))
    cuts = materialize(cuts)
    rows = placed.select(F.col("source").alias("own"), F.col("shard").alias("at"), "class", "run_start", "run_words")
    rows = rows.join(cuts, F.col("own").eqNullSafe(F.col("source")) & (F.col("at") == F.col("shard")) & F.col("class").isin(F.col("first"), F.col("last")))
    is_first, is_last = F.col("class") == F.col("first"), F.col("class") == F.col("last")
    share = lambda name, here: [
        F.count_if(here).alias(f"{name}_rows"), F.min(F.when(here, F.col("run_start"))).alias(f"{name}_start"), F.min(F.when(here, F.col("run_words"))).alias(f"{name}_words")]
    return materialize(rows.groupBy("source", "shard", "rounds", "run", "wraps", "first", "last").agg(*share("first", is_first), *share("last", is_last)))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mixed documents with the columns of ``docs`` (doc_id, text, lang, source, n_chars).

    A document stands there once for each whole copy that is taken, and once more
    for the words of a partial one (joined by single spaces; a run that goes
    round a document's end continues at its beginning).

    Texts are not shuffled: a document is taken if its class lies between those
    that hold the ends of its shard's run, and shares of those two stand in the
    table of shards.  Only rows that share doc_id, size and source with another one
    and hold an end are numbered to tell them apart; they are interchangeable.
    """
    names = docs.columns
    placed, sources = _placed(docs, weights, seed)
    placed = materialize(placed.select("row", "source", "shard", "class", "begin", "end", "start", "run", "shard_size", "rounds", "run_start", "run_words"))
    cuts = _cuts(placed)
    rows = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__source", F.col("source").cast("string")).withColumn("__size", words(F.col("text").cast("string")))
    rows = rows.where("__size > 0").withColumn("__class", _class("__id", "__size", seed))
    named = sources.withColumnRenamed("source", "__of_source")
    rows = rows.join(named, F.col("__source").eqNullSafe(F.col("__of_source"))).withColumn("__shard", _shard("__id", "__size", seed)).drop("shards", "__of_source")
    table = cuts.select(*(F.col(c).alias(f"__{c}") if c not in ("source", "shard") else F.col(c).alias(f"__of_{c}") for c in cuts.columns))
    rows = rows.join(table, F.col("__source").eqNullSafe(F.col("__of_source")) & (F.col("__shard") == F.col("__of_shard")))
    at_first, at_last = F.col("__class") == F.col("__first"), F.col("__class") == F.col("__last")
    behind, before = F.col("__class") > F.col("__first"), F.col("__class") < F.col("__last")
    inside = (F.col("__run") > 0) & F.when(F.col("__wraps"), behind | before).otherwise(behind & before)
    single = rows.where(~(at_first & (F.col("__first_rows") > 1)) & ~(at_last & (F.col("__last_rows") > 1)))
    single = single.withColumn("__start", F.when(at_first, F.col("__first_start")).when(at_last, F.col("__last_start")).otherwise(F.lit(0)))
    single = single.withColumn("__words", F.when(at_first, F.col("__first_words")).when(at_last, F.col("__last_words")).when(inside, F.col("__size")).otherwise(F.lit(0)))
    taken = single.select(*names, "__size", "__rounds", "__start", "__words")
    if cuts.where("first_rows > 1 or last_rows > 1").limit(1).count():
        taken = taken.unionByName(_twins(placed, cuts, rows.where((at_first & (F.col("__first_rows") > 1)) | (at_last & (F.col("__last_rows") > 1))), names))
    return _copies(taken.where("__rounds > 0 or __words > 0"), names)


def _twins(placed: DataFrame, cuts: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` of classes with several rows that hold an end of a run, each with the share of one of the class's places."""
    number = F.row_number().over(Window.partitionBy("__of_source", "__of_shard", "__of_class").orderBy("row"))
    ends = cuts.select(F.col("source").alias("__of_source"), F.col("shard").alias("__of_shard"), F.explode(F.array("first", "last")).alias("__of_class")).distinct()
    at = F.col("source").eqNullSafe(F.col("__of_source")) & (F.col("shard") == F.col("__of_shard")) & (F.col("class") == F.col("__of_class"))
    shares = placed.join(ends, at).select("__of_source", "__of_shard", "__of_class", number.alias("__of_twin"), F.col("run_start").alias("__start"), F.col("run_words").alias("__words"))
    mine = Window.partitionBy("__source", "__shard", "__class").orderBy(F.xxhash64("text"))
    rows = rows.drop("__of_source", "__of_shard").withColumn("__twin", F.row_number().over(mine))
    same = (
        F.col("__source").eqNullSafe(F.col("__of_source")) & (F.col("__shard") == F.col("__of_shard"))
        & (F.col("__class") == F.col("__of_class")) & (F.col("__twin") == F.col("__of_twin")))
    return rows.join(shares, same).select(*names, "__size", "__rounds", "__start", "__words")


def _copies(taken: DataFrame, names: list[str]) -> DataFrame:
    whole = F.when(F.col("__words") == F.col("__size"), F.col("__rounds") + 1).otherwise(F.col("__rounds")).cast("int")
    partial = (F.col("__words") > 0) & (F.col("__words") < F.col("__size"))
    copies = taken.withColumn("__copy", F.explode(F.concat(
        F.transform(F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>")), lambda _: F.lit(False)), F.when(partial, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    each = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    twice = F.concat(each, each)
    part = F.array_join(F.slice(twice, F.col("__start").cast("int") + 1, F.col("__words").cast("int")), " ")
    text = F.when(F.col("__copy"), part).otherwise(F.col("text"))
    out = copies.withColumn("__text", text)
    cut_chars = F.when(F.col("__copy"), F.char_length("__text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in names else None
    columns = [F.col("__text").alias("text") if c == "text" else cut_chars.alias("n_chars") if c == "n_chars" else F.col(c) for c in names]
    return out.select(*columns)
