"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copy probability of each of its documents; the
whole part is taken outright, the fraction is rounded dependently.  Two documents at a
time exchange word mass, in a randomly chosen direction whose odds keep both
expectations, until one of them is integral; the other goes on to the next.  What both
hold together never changes, so a source's total stays on its target, but for the one
document that is left over at the end and rounded by itself.  A document that is much larger than
the next one, or has more than a twentieth of all words behind it, could go through very many such exchanges and still be
open at the end: it is settled in one exchange with a bundle of those behind it, whose open mass matches its own.

Documents are dealt to blocks by a hash of the id, so a hot source is spread.  Each
block settles all but one document of a source; these residuals are combined
``FAN`` blocks at a time, level by level: a reduction tree whose depth is the
logarithm of the rows.  Larger documents go first, so what is left over is among the smallest,
unless one outweighs all behind it together.

Targets: sources in order of code point, null last, weigh ``weights``, repeating;
their targets share ``share`` of all words, but stop at ``most`` times the source's
size; the excess is reshared by weight until none is above.

Defined cases: null text has size 0 and takes 0; a null source is a source; repeated
rows are documents of their own; an empty table gives no rows; draws depend on the
ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm.common import col, cut, free_name, id_type, numbered, same_key

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK_ROWS, FAN, SEED, EPS, FAR, MANY = 4000, 64, 20240229, 1e-9, 2, 20
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank (0-based), source_size, target; one row per source of (source, size).

    Sources are full whose limit per weight the common level - words per weight - reaches;
    the level is raised by what full ones leave over until no other one becomes full.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals.withColumn("last", F.col("source").isNull()), "nth", "last", "source")
    given, rank = F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") - 1).cast("int")
    limit = most * F.col("source_size")
    held = cut(ranked.select("source", rank.alias("rank"), "source_size", F.element_at(given, rank % len(weights) + 1).alias("weight"), limit.alias("limit")))
    every, level, full = held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        is_full = F.col("limit") <= F.lit(level) * F.col("weight")
        n, used, free = held.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not free:
            break
        full, level = n, (share * every - used) / free
    return held.select("source", "rank", "source_size", F.when(F.lit(bool(free)), F.least("limit", F.lit(level) * F.col("weight"))).otherwise(F.col("limit")).alias("target"))


def settle(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round fractions in (0, 1) in the given order; all but the returned index (-1 if none) become 0 or 1."""
    draws, others, w, p = rng.random(size.size).tolist(), rng.random(size.size).tolist(), size.astype(float).tolist(), part.tolist()
    rest, i, aside = size[::-1].cumsum()[::-1].tolist(), -1, []
    for j in range(len(p)):
        if i >= 0 and (w[i] > FAR * w[j] or w[i] * MANY > rest[j]):
            if not _with_bundle(w, p, i, j, others[i]):
                aside.append(i)
            i = -1
        if not EPS < p[j] < 1 - EPS:  # a bundle has settled it
            p[j] = float(round(p[j]))
        else:
            i = j if i < 0 else _pair(w, p, i, j, draws[j])
    for k in reversed(aside):
        i = k if i < 0 else _pair(w, p, k, i, float(rng.random()))
    return np.array(p), i


def _pair(w: list[float], p: list[float], i: int, j: int, draw: float) -> int:
    """Exchange mass until one of two is integral; gives the other, -1 if both are."""
    gain, loss = min((1 - p[i]) * w[i], p[j] * w[j]), min(p[i] * w[i], (1 - p[j]) * w[j])
    moved = gain if draw * (gain + loss) < loss else -loss
    p[i], p[j] = p[i] + moved / w[i], p[j] - moved / w[j]
    open_ones = [k for k in (i, j) if EPS < p[k] < 1 - EPS]
    for k in (i, j):
        if k not in open_ones:
            p[k] = float(round(p[k]))
    return open_ones[0] if open_ones else -1


def _with_bundle(w: list[float], p: list[float], i: int, j: int, draw: float) -> bool:
    """The i-th document goes up or down in exchange with those from the j-th on; whether it became integral.

    Each of these gives or takes a fixed share of the mass, whichever way it goes, so every expectation is kept; shares are as large as
    both ways allow.  Where all of them together don't allow the longer way, that one is shortened, and the odds with it.
    """
    ways = [(1 - p[i]) * w[i], p[i] * w[i]]
    shares = _shares(w, p, j, *ways)
    for longer in sorted((0, 1), key=lambda k: -ways[k]):
        if sum(shares.values()) >= 1:
            break
        low, high = 0.0, ways[longer]
        for _ in range(40):
            ways[longer] = (low + high) / 2
            low, high = (ways[longer], high) if sum(_shares(w, p, j, *ways).values()) >= 1 else (low, ways[longer])
        ways[longer] = low
        shares = _shares(w, p, j, *ways)
    up, down = ways
    every = sum(shares.values())
    if every < 1 or not up + down:
        return False  # nothing behind it is open
    rises = draw * (up + down) < down
    moved = up if rises else -down
    p[i] += moved / w[i]
    for k, share in shares.items():
        p[k] = min(1.0, max(0.0, p[k] - moved * share / every / w[k]))
    if whole := not EPS < p[i] < 1 - EPS:
        p[i] = float(round(p[i]))
    return whole


def _shares(w: list[float], p: list[float], j: int, up: float, down: float) -> dict[int, float]:
    """Of each document from the j-th on: the part of both ways that it can give and take; no more documents than are needed."""
    found, every = {}, 0.0
    for k in range(j, len(p)):
        found[k] = max(0.0, min(p[k] * w[k] / up if up else 1.0, (1 - p[k]) * w[k] / down if down else 1.0))
        every += found[k]
        if every >= 1:
            break
    return found


def settle_block(last: bool, level: int):
    """For applyInPandas over a block: rows of every source but one get their copies; of the last block's, all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "size", "draw"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
        part, extra = rows["part"].to_numpy().copy(), np.full(len(rows), -1, np.int64)
        fixed = (part <= EPS) | (part >= 1 - EPS)
        extra[fixed] = part[fixed].round().astype(np.int64)
        for rank, at in rows[~fixed].groupby("rank").groups.items():
            at, block = np.asarray(at), int(rows["block"].iloc[0])
            rng = np.random.default_rng([SEED, level, block, int(rank)])
            parts, left = settle(rows["size"].to_numpy()[at], part[at], rng)
            if last and left >= 0:
                parts[left], left = float(rng.random() < parts[left]), -1
            whole = parts.round().astype(np.int64)
            if left >= 0:
                whole[left] = -1
            extra[at], part[at] = whole, parts
        return rows.assign(part=part, extra=extra, block=rows["block"] // FAN)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    size = F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sizes = cut(docs.select(col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), size.alias("size")))
    targets = cut(source_targets(sizes, weights, share, most))
    blocks = max(1, math.ceil(sizes.count() / BLOCK_ROWS))
    draw = F.xxhash64(F.lit(SEED), "doc_id", "size")
    chance = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).select(
        "doc_id", sizes.source, "rank", "size", "source_size", "target", draw.alias("draw"),
        F.floor(chance).cast("long").alias("copies"), (chance - F.floor(chance)).alias("part"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)).alias("block"),
        F.floor(F.col("rank") / BLOCK_ROWS).cast("int").alias("ranks"),
    )
    schema = f"doc_id {id_type(docs, id_col)}, source string, rank int, size long, source_size long, target double, draw long, copies long, part double, block long, ranks int, extra long"
    settled, rest, level = [], wanted, 0
    while True:
        out = cut(rest.groupBy("block", "ranks").applyInPandas(settle_block(blocks == 1, level), schema))
        settled.append(out.where("extra >= 0"))
        if blocks == 1:
            break
        rest, blocks, level = out.where("extra < 0").drop("extra"), math.ceil(blocks / FAN), level + 1
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    copies = F.col("copies") + F.col("extra")
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the documents that it takes, with their columns and size, source_size, target, copies, taken.

    Columns of ``docs`` with these names give way.  Repeated rows of an id share the copies
    that these rows were given together.  The texts are dealt once, by a key of id, source
    and size on which copies join and repeated rows are told apart.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    key, own, nth, row = (free_name(docs, f"mix_{c}") for c in ("key", "own", "nth", "row"))
    mixed = mix(docs, id_col, text_col, source_col)
    taken = mixed.groupBy(same_key(F.col("doc_id"), F.col("source"), F.col("size")).alias(key)).agg(
        F.struct(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).alias(own)
    ).where(F.col(own)["copies"] > 0)
    size = F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    met = docs.withColumn(key, same_key(col(id_col), col(source_col), size)).join(taken.hint("shuffle_hash"), key)
    order = Window.partitionBy(key).orderBy(*(F.xxhash64(col(c)) for c in docs.columns))
    copies, rows = F.col(own)["copies"], F.col(own)["rows"]
    shared = met.withColumn(nth, F.row_number().over(order)).withColumn(row, F.floor(copies / rows) + (F.col(nth) <= copies % rows).cast("long")).where(F.col(row) > 0)
    values = {"size": F.col(own)["size"], "source_size": F.col(own)["source_size"], "target": F.col(own)["target"], "copies": F.col(row), "taken": F.col(row) * F.col(own)["size"]}
    return shared.select(*(col(c) for c in docs.columns if c.lower() not in added), *(values[c].alias(c) for c in added))
