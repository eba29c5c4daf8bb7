"""Joins of intervals by bins, fence state and packing of documents of any size, as relations.

Everything here works on rows of (document, place), so a document is spread over as many tasks
as its rows ask for; no step gathers one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import columns as C
from quillspark.operators.lineage import cut

BIN = 4096


def bins(start: Column, end: Column, width: int = BIN) -> Column:
    """The bins that a half-open interval touches; an empty one touches the bin of its place."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def overlaps(left: DataFrame, right: DataFrame, on: str = "doc_id", width: int = BIN) -> DataFrame:
    """Every pair of overlapping half-open intervals of one document, once.

    Both tables have ``on``, start and end; other columns of the right one must be its own.  Gives all columns of
    the left one and, of the right one, start and end as r_start and r_end and the others.  Intervals are filed under the bins
    that they touch and meet by equality on document and bin; a pair that shares several is kept in the first that
    both touch.  Choose a width of about the longer side's usual length.  Empty intervals overlap nothing.
    """
    filed = lambda df: df.where(F.col("start") < F.col("end")).withColumn("__bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    other = filed(right.withColumnsRenamed({"start": "r_start", "end": "r_end"}).withColumns({"start": F.col("r_start"), "end": F.col("r_end")})).drop("start", "end")
    met = filed(left).join(other, [on, "__bin"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    first = F.floor(F.greatest("start", "r_start") / width)
    return met.where(F.col("__bin") == first).drop("__bin")


# Fence state as an associative scan.  What a run of lines does is a map from the fence that is open before it to the one that is open
# behind it.  Where a fence of character c and length n is open, the run's first bare fence line of c with at least n characters ends it,
# so all lengths between two of the run's bare lines act alike: an entry for each kind of bare line and one for "no fence" tell the whole
# map, and a fence that no entry is long enough for stays open.

def _none() -> Column:
    return F.struct(F.lit("").alias("mark"), F.lit(0).alias("size"))


def _after(state: Column, m: Column) -> Column:
    """The state behind a fence line."""
    ends = m["bare"] & (m["mark"] == state["mark"]) & (m["size"] >= state["size"])
    opened = F.struct(m["mark"].alias("mark"), m["size"].alias("size"))
    return F.when(state["mark"] == "", opened).when(ends, _none()).otherwise(F.struct(state["mark"].alias("mark"), state["size"].alias("size")))


def _through(state: Column, entries: Column) -> Column:
    """The state behind a run of lines, by its map."""
    fits = F.filter(entries, lambda e: (e["mark"] == state["mark"]) & (e["size"] >= state["size"]))
    best = F.array_min(F.transform(fits, lambda e: F.struct(e["size"].alias("size"), e["behind"].alias("behind"))))
    return F.coalesce(best["behind"], F.struct(state["mark"].alias("mark"), state["size"].alias("size")))


def fence_state(lines: DataFrame, id_col: str = "doc_id", block: int = 4096) -> DataFrame:
    """doc_id, line_no, in_fence of lines (doc_id, line_no from 1 without gaps, line): whether a block is open before each.

    Blocks of ``block`` lines are folded in parallel into maps from state to state; the maps of a document, one small
    row a block, are composed in order; then each block is run through from the state that is known to be before it.
    Only fence lines are folded, and lines are shuffled once, by document and block.
    """
    line = F.col("line")
    token, bare = C.fence_opener(line), line.rlike(r"^[ \t]*(`{3,}|~{3,})[ \t]*$")
    fence = F.when(token != "", F.struct("line_no", F.substring(token, 1, 1).alias("mark"), F.length(token).alias("size"), bare.alias("bare")))
    rows = lines.select(id_col, "line_no", F.floor((F.col("line_no") - 1) / block).alias("block"), fence.alias("fence"))
    folded = rows.groupBy(id_col, "block").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.sort_array(F.collect_list("fence")).alias("marks"))
    kinds = F.array_distinct(F.concat(F.array(_none()), F.transform(F.filter("marks", lambda m: m["bare"]), lambda m: F.struct(m["mark"].alias("mark"), m["size"].alias("size")))))
    entries = F.transform(kinds, lambda k: F.struct(k["mark"].alias("mark"), k["size"].alias("size"), F.aggregate("marks", k, _after).alias("behind")))
    blocks = cut(folded.withColumn("entries", entries))
    maps = blocks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("block", "entries"))).alias("maps"))
    start = F.struct(_none().alias("state"), F.array().cast("array<struct<block:bigint,before:struct<mark:string,size:int>>>").alias("seen"))
    walked = F.aggregate("maps", start, lambda s, m: F.struct(_through(s["state"], m["entries"]).alias("state"), F.concat(s["seen"], F.array(F.struct(m["block"].alias("block"), s["state"].alias("before")))).alias("seen")))
    before = maps.select(id_col, F.explode(walked["seen"]).alias("s")).select(id_col, "s.block", "s.before")
    state = F.aggregate(
        "marks", F.struct(F.col("before").alias("state"), F.array(F.col("first")).alias("cuts")),
        lambda s, m: F.struct(_after(s["state"], m).alias("state"), F.when((_after(s["state"], m)["mark"] == "") != (s["state"]["mark"] == ""), F.concat(s["cuts"], F.array(m["line_no"] + 1))).otherwise(s["cuts"]).alias("cuts")),
    )
    known = blocks.join(before, [id_col, "block"]).select(id_col, "first", (F.col("before.mark") != "").alias("open"), F.concat(state["cuts"], F.array(F.col("last") + 1)).alias("cuts"))
    lengths = F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1), lambda a, b: (b - a).cast("int"))
    flags = F.flatten(F.transform(lengths, lambda n, k: F.array_repeat((k % 2 == 1) != F.col("open"), n)))
    return known.select(id_col, "first", F.posexplode(flags).alias("at", "in_fence")).select(id_col, (F.col("first") + F.col("at")).alias("line_no"), "in_fence")


# Packing with reset.


def running(rows: DataFrame, value: str, name: str, key: tuple[str, ...], at: str, block: int = 4096) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row of a key, in order of ``at`` (numbers without gaps): blocks sum by themselves, and sums of blocks are added."""
    placed = rows.withColumn("__block", F.floor(F.col(at) / block))
    inside = Window.partitionBy(*key, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*key, "__block").agg(F.sum(value).alias("__sum")).select(*key, "__block", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    met = placed.withColumn("__own", F.sum(value).over(inside)).join(sums, [*key, "__block"])
    return met.withColumn(name, F.col("__own") + F.col("__ahead")).drop("__block", "__own", "__ahead")


def packed(units: DataFrame, most: int, key: tuple[str, ...] = ("doc_id",), at: str = "unit", size: str = "size", block: int = 4096) -> DataFrame:
    """``key``, at, chunk (from 1): units in order fill chunks of at most ``most``, each until the next one has no room.

    ``units``: ``key``, at (from 1 without gaps) and a size of ``most`` at most.  Prefix sums tell where a chunk that began at a unit would
    end: its end is the last prefix within ``most``, found by an as-of join in bins of ``most``, of which each holds a prefix until
    the last.  Which units do begin a chunk follows by pointer doubling from the first one: chunks double each round.
    """
    keys = list(key)
    sums = cut(running(units.select(*keys, at, size), size, "upto", key, at, block).withColumn("before", F.col("upto") - F.col(size)))
    wanted = sums.select(*keys, F.floor((F.col("before") + most) / most).alias("bin"), (F.col("before") + most).alias("place"), F.lit(None).cast("bigint").alias("held"), F.col(at).alias("asks"))
    there = sums.select(*keys, F.floor(F.col("upto") / most).alias("bin"), F.col("upto").alias("place"), F.col(at).cast("bigint").alias("held"), F.lit(None).cast(units.schema[at].dataType).alias("asks"))
    up_to = Window.partitionBy(*keys, "bin").orderBy("place", F.col("held").asc_nulls_last())  # of one place, units come before questions
    found = wanted.unionByName(there).withColumn("last", F.max("held").over(up_to.rowsBetween(Window.unboundedPreceding, 0))).where("asks IS NOT NULL")
    ends = there.groupBy(*keys, "bin").agg(F.max("held").alias("bin_last")).withColumn("bin", F.col("bin") + 1)
    jump = cut(found.join(ends, [*keys, "bin"], "left").select(*keys, F.col("asks").cast("bigint").alias("from"), (F.coalesce("last", "bin_last") + 1).alias("to")).join(
        sums.select(*keys, F.col(at).cast("bigint").alias("to")), [*keys, "to"], "left_semi"))  # behind the last chunk there is no unit
    begins, known = cut(sums.groupBy(*keys).agg(F.min(at).cast("bigint").alias("from"))), -1
    while (now := begins.count()) != known:
        known = now
        begins = cut(begins.unionByName(begins.join(jump, [*keys, "from"]).select(*keys, F.col("to").alias("from"))).distinct())
        jump = cut(jump.join(jump.select(*keys, F.col("from").alias("to"), F.col("to").alias("on")), [*keys, "to"]).select(*keys, "from", F.col("on").alias("to")))
    marked = sums.select(*keys, at).join(begins.select(*keys, F.col("from").cast(units.schema[at].dataType).alias(at), F.lit(1).alias("__first")), [*keys, at], "left").withColumn("__first", F.coalesce("__first", F.lit(0)))
    return running(marked, "__first", "chunk", key, at, block).drop("__first")
