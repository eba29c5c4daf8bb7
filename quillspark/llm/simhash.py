"""SimHash near-dedup over covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, every run of
``shingle`` words joined by spaces (a shorter text is one shingle), XXH64 with
seed 42 of each, repeats included; a bit is set when more than half of the hashes
set it.  No word, or null: zero, which links like any other.

Search: bit ``i`` of the fingerprint gets a vector m(i) of ``radius + 1`` bits, and
every non-zero vector v gives a mask that keeps the bits with odd <m(i), v>.  Up to
``radius`` differing bits are as many equations on v, so some mask drops them all:
each pair within the radius meets in a table, and no parameter trades recall.
Only distinct fingerprints are put in the tables.  Inside a bucket a search from
member to member gives a spanning forest of its links: at most one row a member,
never all pairs.  Large buckets are dealt again by more bits, which loses no pair either.

Defined cases: repeated rows share a fingerprint; null ids never become a
component's id unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import col, cut, free_name, id_type
from quillspark.llm.components import connected_components

SHINGLE, RADIUS, SEED, BLOCK, HEAVY, BUCKET, LEVELS = 4, 4, 42, 1 << 15, 256, 1 << 13, 3
TABLE = (1 << 12) - 1  # a bucket's key has the number of its table in these bits


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.cumsum([0, *map(len, words)], dtype=np.int64) + np.arange(len(words) + 1)
    n = max(1, len(words) - shingle + 1)
    ends = (starts[min(shingle, len(words)) :] - 1).tolist()
    begins, ones = starts.tolist(), np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        hashes = np.array([of(joined[i:j], SEED) for i, j in zip(begins[k : min(n, k + BLOCK)], ends[k : k + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; any ``radius`` bits are all dropped by at least one."""
    vectors = 1 << (radius + 1)
    given = [i % (vectors - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(given) if (m & v).bit_count() & 1) for v in range(1, vectors)]


def bucket_forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints: both ends, in blocks."""
    left, right, rest = [], [], fps
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(found.size, at))
                right.append(found)
                queue.extend(found)
    return left, right


def finer_masks(masks: list[int], radius: int, level: int) -> list[int]:
    """For each mask ``radius + 1`` finer ones: each keeps another share of the bits that the mask drops.

    Up to ``radius`` differing bits leave at least one share alone, so a pair within the
    radius that meets under the mask meets under one of its finer ones.
    """
    shares = radius + 1
    out = []
    for m in masks:
        free = [i for i in range(64) if not m >> i & 1]
        out += [m | sum(1 << i for k, i in enumerate(free) if (k * (level + 1) + k // shares) % shares == share) for share in range(shares)]
    return out


def dealing(masks: list[int], shares: int):
    """For mapInArrow over (fp, table): key and fp under each of the ``shares`` finer tables of the one given."""
    mask = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, table = np.repeat(batch.column(0).to_numpy(), shares), np.repeat(batch.column(1).to_numpy(), shares) * shares
            table = table + np.tile(np.arange(shares), batch.num_rows)
            key = (fp.view(np.uint64) & mask[table]) * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays([pa.array((key ^ key >> np.uint64(29)).view(np.int64) & ~TABLE | table), pa.array(fp)], ["key", "fp"])

    return run


def links_of_buckets(radius: int, most: int | None):
    """For mapInArrow over (key, fp) sorted by key: the links inside each bucket as (a, b, null).

    Members of a bucket of more than ``most`` are given on as (fp, null, table), to be dealt more finely.
    """

    def batch_of(a: np.ndarray, b: np.ndarray | None, table: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(a.size, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (a, b, table)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "table"])

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [keys.size]])
        two = starts[ends - starts == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius] if two.size else two
        left, right = [fps[near]], [fps[near + 1]]
        for k in np.flatnonzero(ends - starts > 2):
            mine = slice(starts[k], ends[k])
            if most and ends[k] - starts[k] > most:
                yield batch_of(fps[mine], None, keys[mine] & TABLE)
            else:
                a, b = bucket_forest(fps[mine], radius)
                left += a
                right += b
        yield batch_of(np.concatenate(left), np.concatenate(right), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # what came since the last complete bucket
        heavy = None  # key of an open bucket that is known to be too large
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if heavy is not None and key.size and (n := int(np.searchsorted(key, heavy, "right"))):
                yield batch_of(fp[:n], None, key[:n] & TABLE)
                key, fp = key[n:], fp[n:]
            if not key.size:
                continue
            heavy = None
            held.append((key, fp))
            if key[-1] == held[0][0][0] and not (most and sum(k.size for k, _ in held) > most):
                continue  # the open bucket waits for the next batch
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from links(key[:last], fp[:last])
            held = [(key[last:], fp[last:])]
            if most and key.size - last > most:
                heavy, held = key[-1], []
                yield batch_of(fp[last:], None, key[last:] & TABLE)
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that connect exactly what all pairs of ``fp`` within the radius connect.

    Buckets of more than ``BUCKET`` members are dealt again by more bits, ``LEVELS`` times
    at most: by then a bucket's members agree in all but some 16 bits, so it is bounded.
    """
    masks, out = covering_masks(radius), None
    tables = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)))).bitwiseAND(F.lit(~TABLE)).bitwiseOR(F.lit(t)) for t, m in enumerate(masks)]
    dealt = distinct.select("fp", F.explode(F.array(*tables)).alias("key")).select("key", "fp")
    for level in range(LEVELS + 1):
        buckets = dealt.repartition("key").sortWithinPartitions("key")
        found = cut(buckets.mapInArrow(links_of_buckets(radius, BUCKET if level < LEVELS else None), "a long, b long, table long"))
        links, rest = found.where("table IS NULL").select("a", "b"), found.where("table IS NOT NULL").select("a", "table")
        out = links if out is None else out.unionByName(links)
        if level == LEVELS or rest.isEmpty():
            break
        masks = finer_masks(masks, radius, level)
        dealt = rest.mapInArrow(dealing(masks, radius + 1), "key long, fp long")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = connected_components(near_links(distinct.select("fp"), radius), "a", "b")
    member = distinct.join(linked, distinct.fp == linked.node).select("fp", "least", "component")
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "component").select("fp", "component_id")
    known = cut(distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    return _by_fingerprint(fps, known).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _by_fingerprint(fps: DataFrame, known: DataFrame) -> DataFrame:
    """Join on the fingerprint: those of more than one in ``HEAVY`` rows, fewer than ``HEAVY`` by that, are broadcast."""
    rows = known.agg(F.sum("n")).first()[0] or 0
    heavy, light = (known.where(c).drop("n") for c in (F.col("n") * HEAVY > rows, F.col("n") * HEAVY <= rows))
    hot = fps.join(F.broadcast(heavy), "fp")
    return hot.unionByName(fps.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(light, "fp"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with all its columns.

    Rows with a null id, and repeated rows of the id that stays, are kept.
    """
    name = free_name(docs, "near_gone")
    groups = near_duplicates(docs, id_col, text_col, shingle, radius)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(gone.hint("shuffle_hash"), col(id_col) == F.col(name), "left_anti")
