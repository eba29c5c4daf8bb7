"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Every text becomes a SHA-256 digest, and only digests travel:

1. each task keeps a Misra-Gries summary of its digests; the summaries are summed
   and the ``counters`` largest become candidates,
2. one exact pass over the digests verifies them (count and row that stays),
3. verified winners - at most ``counters`` rows - are broadcast, and their copies
   are decided map-side,
4. all other digests, each rarer than one in ``counters``, take an ordinary shuffle.

A digest that the summaries miss is only slower: step 4 decides it exactly.

Defined cases: null and empty texts form one group; of equal texts the row with
the largest id stays (null ids lose against any id); of repeated rows with that id
exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm.common import ascii_lower, col, cut, free_name, same_key

COUNTERS = 255


def shrink(counts: Counter, counters: int) -> Counter:
    """Reduce a summary to ``counters`` entries: subtract the largest count that has to go."""
    if len(counts) <= counters:
        return counts
    over = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - over for k, n in counts.items() if n > over})


def misra_gries(counters: int):
    """A function for mapInArrow: one summary of a task's digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(batch.column(0).to_pylist())
            seen = shrink(seen, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["digest", "n"])

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (binary) and row (tells repeated rows apart), with the lineage cut."""
    found = docs.select(col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(col(text_col)).cast("binary"), 256)).alias("digest"))
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


def heavy_digests(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The digests of more than one in ``counters + 1`` rows: digest, group_size, best (id and row that stays)."""
    rows = hashed.count()
    candidates = (
        hashed.select("digest").mapInArrow(misra_gries(counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    )
    verified = hashed.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))
    return cut(verified.where(F.col("group_size") * (counters + 1) > rows))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = digests(docs, id_col, text_col)
    heavy = heavy_digests(hashed, counters)
    mapped = hashed.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    shuffled = hashed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "digest", "doc_id", "row", F.count(F.lit(1)).over(group).alias("group_size"), F.max(F.struct("doc_id", "row")).over(group).alias("best")
    )
    return mapped.select(shuffled.columns).unionByName(shuffled).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns and repeated rows gone.

    Keys of kept rows travel - digest and id - and the texts are dealt by it once: the
    join and the choice among repeated rows share the exchange.
    """
    key, nth = free_name(docs, "dedup_key"), free_name(docs, "dedup_nth")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(same_key(F.col("text_sha256"), F.col("doc_id")).alias(key))
    own = same_key(F.sha2(ascii_lower(col(text_col)).cast("binary"), 256), col(id_col))
    met = docs.withColumn(key, own).join(kept.hint("shuffle_hash"), key, "left_semi")
    same = Window.partitionBy(key).orderBy(*(F.xxhash64(col(c)) for c in docs.columns))
    return met.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*(col(c) for c in docs.columns))
