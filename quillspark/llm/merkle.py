"""Merkle manifest of a dataset by message passing over its tree, in RDD supersteps.

Every row is a leaf: a SHA-256 over its fields.  The leaves of a group, in order, are
the lowest vertices of a tree of arity three.  Going up, children message their digest
to their parent, and a parent that has heard all of its children hashes them and
forwards the result.  A vertex without any neighbour in its group has no parent to
message: it halts, and its digest is the group's root.  The groups' roots are the leaves
of one more tree, whose root stands for the dataset.  Going down, each parent tells
every child the digests that it needs to reach the root - the child's siblings, then the
path that the parent was told - until leaves hold their proofs and fold them.

Vertices of ``REACH`` levels that have a common ancestor (at most 729 of the lowest of
these levels) lie together, so messages among them stay in their task; each superstep
over RDDs carries what crosses: one digest a block upward, one path a block downward.
A group however large is so many blocks, dealt by group and block.  A block needs no
counts: only the first block of a group can hold a level of a single vertex without
any neighbour elsewhere, as it is full where others exist.

Digests of leaves and the numbers of rows are checkpointed, and each superstep begins
with a shuffle, so a lost executor costs the tasks of its own blocks.

Defined cases: fields that are null count as ``-``; rows of a group ascend by id (null
first), then by leaf, and what is still equal has equal leaves; null is a group of its
own and comes first; rows with a null id aren't tampered with; an empty table has no
root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import partial
from hashlib import sha256
from zlib import crc32

from pyspark import RDD
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructType

from quillspark.functions.arrow import scanner
from quillspark.llm.common import col, cut, free_name, numbered

ARITY, REACH, TASK_ROWS = 3, 6, 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*fields: Column) -> Column:
    """SHA-256 of fields as binary: each ``-`` if null, else its UTF-8 bytes behind their number and a colon."""
    shown = (c.cast("string") for c in fields)
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)).cast("binary"), 256))


def combined(digests: Iterable[bytes]) -> bytes:
    """What a parent makes of its children's digests, which are hashed as hex text."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


def climb(lowest: list[bytes], first: bool, reach: int) -> list[list[bytes]]:
    """Supersteps inside a block: the vertices of each of its levels.  ``first``: it is its group's first block."""
    levels = [lowest]
    for _ in range(reach):
        sent = levels[-1]
        halts = first and len(sent) == 1
        levels.append(sent if halts else [combined(sent[k : k + ARITY]) for k in range(0, len(sent), ARITY)])
    return levels


def path_down(levels: list[list[bytes]], at: int, first: bool) -> bytes:
    """What a block's lowest vertex is told within it, level by level: its place, the number of its siblings, their digests."""
    told = []
    for children in levels[:-1]:
        if not (first and len(children) == 1):
            run = at - at % ARITY
            near = [children[k] for k in range(run, min(run + ARITY, len(children))) if k != at]
            told.append(bytes([at - run, len(near)]) + b"".join(near))
        at //= ARITY
    return b"".join(told)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place and siblings of each level of a path."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[k : k + 32] for k in range(at + 2, at + 2 + 32 * n, 32)]
        at += 2 + 32 * n


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf leads to with the siblings of a path."""
    for place, near in steps(path):
        leaf = combined([*near[:place], leaf, *near[place:]])
    return leaf


def proof_digest(path: bytes) -> bytes:
    return combined(d for _, near in steps(path) for d in near)


def _place(key: tuple) -> int:
    """Deals blocks to tasks, alike in every process."""
    return crc32(repr(key).encode("utf-8", "surrogatepass"))


class Tree:
    """The trees of all groups over ``vertices``: ((group, number from 0), (digest, whatever belongs to it)) for each leaf.

    ``largest``: leaves of the largest group; ``rows``: leaves of all.
    """

    def __init__(self, vertices: RDD, largest: int, rows: int, reach: int = REACH):
        self.rounds: list[RDD] = []
        self.reach, width, span = reach, ARITY**reach, 1
        while not self.rounds or span < largest:
            tasks = max(vertices.context.defaultParallelism, rows // span // TASK_ROWS)
            sent = vertices.map(lambda kv: ((kv[0][0], kv[0][1] // width), (kv[0][1] % width, kv[1])))
            self.rounds.append(sent.groupByKey(tasks, _place).mapValues(lambda got: [v for _, v in sorted(got, key=lambda x: x[0])]))
            vertices = self.rounds[-1].map(lambda kb: (kb[0], (climb([v[0] for v in kb[1]], kb[0][1] == 0, reach)[-1][0], None)))
            span *= width
        #: (group, digest) for each group.
        self.roots = vertices.map(lambda kv: (kv[0][0], kv[1][0]))

    def told(self, messages: RDD) -> RDD:
        """(what belongs to a leaf, its digest, what its group was told, path) for each leaf; ``messages``: (group, (word, path beyond its root))."""
        down = messages.map(lambda gm: ((gm[0], 0), gm[1]))
        for k, blocks in reversed(list(enumerate(self.rounds))):
            n = blocks.getNumPartitions()  # a block and its message meet where the block lies; only messages travel
            met = blocks.mapValues(lambda b: (0, b)).union(down.partitionBy(n, _place).mapValues(lambda m: (1, m))).groupByKey(n, _place)
            down = met.flatMap(partial(_tell_leaves if k == 0 else _tell, self.reach))
        return down


def _heard(reach: int, met: tuple) -> Iterator[tuple]:
    """A block's vertices with what each is told: its block's top was told a word and a path."""
    (group, block), both = met
    parts = dict(both)
    vertices, (word, path) = parts[0], parts[1]
    levels = climb([v[0] for v in vertices], block == 0, reach)
    for at, v in enumerate(vertices):
        yield (group, block * ARITY**reach + at), v, word, path_down(levels, at, block == 0) + path


def _tell(reach: int, met: tuple) -> Iterator[tuple]:
    """A downward superstep: the lowest vertices of a block are the tops of others."""
    for key, _, word, path in _heard(reach, met):
        yield key, (word, path)


def _tell_leaves(reach: int, met: tuple) -> Iterator[tuple]:
    for _, (digest, own), word, path in _heard(reach, met):
        yield own, digest, word, path


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf (binary), and ``extra`` columns made of the same rows."""
    own = [c.alias(name) for name, c in (extra or {}).items()]
    return docs.select(col(id_col).alias("doc_id"), col(group_col).cast("string").alias("source"), digest_of(*map(col, fields)).alias("leaf"), *own)


def proofs(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``found`` (doc_id, source, leaf and any other columns) with subroot, root and path, all binary.

    ``path``: for each level from the leaf to the root one byte for the place among the run, one for the number of siblings, and their digests.
    """
    spark = found.sparkSession
    order, nth = free_name(found, "merkle_row"), free_name(found, "merkle_nth")
    rows = cut(found.withColumn(order, F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    largest, every, groups = (n or 0 for n in sizes)
    placed = numbered(rows, nth, "source", "doc_id", "leaf", order, within="source").drop(order)
    given = placed.select("source", nth, "leaf", F.struct(*(col(c) for c in found.columns if c != "leaf")).alias("own"))
    below = Tree(given.rdd.map(lambda r: ((r[0], r[1] - 1), (bytes(r[2]), tuple(r[3])))), largest, every, reach)
    subroots = spark.createDataFrame(below.roots, "source string, subroot binary", verifySchema=False)
    above = Tree(numbered(subroots, "nth", "source").rdd.map(lambda r: (("", r[2] - 1), (bytes(r[1]), r[0]))), groups, groups, reach)
    known = above.told(above.roots.map(lambda gd: (gd[0], (gd[1], b""))))
    paths = below.told(known.map(lambda t: (t[0], ((t[1], t[2]), t[3]))))
    kinds = StructType([f for f in found.schema if f.name != "leaf"])
    for name in ("leaf", "subroot", "root", "path"):
        kinds = kinds.add(name, BinaryType())
    return spark.createDataFrame(paths.map(lambda t: (*t[0], t[1], *t[2], t[3])), kinds, verifySchema=False)


#: The root that a leaf leads to (leaf, path): a dataset is intact where that is its root.
folded_root = scanner(folded, "binary")
#: One digest over the siblings of a path, from left to right and upward.
proof_sha256 = scanner(proof_digest, "binary")


def verified(found: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``found`` as ``proofs`` gives it: doc_id, leaf, subroot, root, proof_sha256, folded_root (of column ``leaf``), verified; digests as hex."""
    shown = found.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"),
        F.lower(F.hex(proof_sha256(F.col("path")))).alias("proof_sha256"), F.lower(F.hex(folded_root(F.col(leaf), F.col("path")))).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends(docs: DataFrame, text_col: str = "text") -> Column:
    """The tampering that the check looks for, in rows whose id has an even CRC-32: the text without its line ends."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(chosen, F.replace(col(text_col), F.lit("\n"), F.lit(""))).otherwise(col(text_col))
