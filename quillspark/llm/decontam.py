"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are read as words (runs of letters and digits, lower-cased) joined by single
spaces.  A CGK walk over the characters reads one at its pointer and moves on when that
character's random bit for the step is set: after an edit two walks soon fall into step
again, so edit distance turns into Hamming distance between the symbols read.  Every
word of a document starts a window, and ``WALKS`` independent walks go through each;
they go as far as the size of the item asks for.  A hash table samples some steps of one
walk: a mask over the symbols read.  An item has the keys of all its words, so many
tables and anchors share the work, and the number of steps sampled falls with the size of
the item such that recall stays above the target (``CLASSES``; measured in tests, by
length and kind of edit, where similarity is as low as it may be).  Items walk only inside
themselves, so verbatim copies are certain.

A place is verified where a word collides; for items of ``MANY`` characters and eight
words or more, where two of their words agree on it, give or take the edits.  Two bounds
over whole arrays rule out most places without loss: a part with e edits keeps all but
4 e of the item's grams near where they were, and the edit distance of characters folded
to 64 symbols is no larger than the true one.  Then the exact edit distance between the
item and the best part of the text within reach decides, similarity 1 - edits / length.

The items' keys are made on executors and go to the tasks as arrays, in blocks of about
``BLOCK_ANCHORS`` words, whatever their number: each block is one pass over all rows,
nothing is shuffled and no candidate is dropped.

Items of less than ``LEAST`` characters have room for one edit at most, and none below five:
they are found exactly wherever they stand in a text from a word's start on, by all strings that one
deletion makes of the item and of the text there.

Defined cases: null and wordless texts match nothing; items without words are left out; repeated rows and items each have their own rows; an empty table gives
no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.codepoints import codes, folded, runs
from quillspark.llm.common import col, cut, id_type

WALKS, STEPS, SIMILARITY, BLOCK_ANCHORS, BATCH_CHARS, PIECE = 4, 32, 0.8, 200_000, 1 << 21, 1 << 15
#: Classes of items by characters: at least so many, steps of a walk that go into a key, steps that it may take them from.
CLASSES = ((80, 12, 30), (48, 10, 24), (32, 8, 18), (18, 6, 13), (10, 4, 9))
TABLES, LEAST, RUN, SPACE, GRAM, GRAM_BITS, BAND, MANY, FAR = 3, CLASSES[-1][0], 8, 32, 4, 12, 32, 176, 16
TINY = range(5, LEAST)  # sizes with room for one edit and no walk
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROUND = (1 << 64) - 1


def word_runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points, starts and ends of the words of a text."""
    points = folded()[codes(text)]
    return points, *runs(points != 0)


def joined(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words as code points, joined by single spaces, and where each of them starts."""
    sizes = ends - starts + 1
    places = np.cumsum(sizes) - sizes
    out, inside = np.full(max(0, int(sizes.sum()) - 1), SPACE, np.uint32), np.ones(max(0, int(sizes.sum()) - 1), bool)
    inside[places[1:] - 1] = False
    out[inside] = points[points != 0]
    return out, places


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def plain(text: str) -> str:
    """What is compared: the words of a text, joined by single spaces."""
    return as_text(joined(*word_runs(text))[0])


@cache
def symbols() -> np.ndarray:
    """By code point: its symbol in a walk, one of 256."""
    c = np.arange(0x110000, dtype=np.uint32)
    return ((c ^ (c >> 8) * np.uint32(151)) & np.uint32(255)).astype(np.uint8)


@cache
def moves() -> np.ndarray:
    """By walk, step and symbol: whether the pointer moves on."""
    return np.random.default_rng(7).integers(0, 2, (WALKS, STEPS, 256), dtype=np.int32)


@cache
def masks() -> dict[int, np.ndarray]:
    """By class of items (its least characters): which of the bytes read go into each table's key, as 64-bit words."""
    out = {}
    for least, count, span in CLASSES:
        bytes_of = np.zeros((TABLES, STEPS), np.uint8)
        for t in range(TABLES):
            bytes_of[t, sorted(random.Random(f"{span} {t}").sample(range(t, span), count))] = 255
        out[least] = bytes_of.view(np.uint64)
    return out


def class_of(size: int) -> int:
    """The least characters of an item's class; 0 for the smallest ones."""
    return next((least for least, _, _ in CLASSES if size >= least), 0)


def walk(points: np.ndarray, starts: np.ndarray, w: int, steps: int, places: list[np.ndarray] | None = None) -> np.ndarray:
    """The symbols that a walk reads from each start, as 64-bit words by row; the places of each step's readings go to ``places``."""
    read, at = np.zeros((starts.size, STEPS), np.uint8), starts.astype(np.int32)
    for j in range(steps):
        if places is not None:
            places.append(at)
        symbol = points.take(at, mode="clip")
        read[:, j] = symbol
        at = at + moves()[w, j].take(symbol)
    return read.view(np.uint64)


def _key(words: np.ndarray, mask: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of the bytes under a mask."""
    key = np.full(len(words), salt, np.uint64)
    for k in np.flatnonzero(mask):
        key = (key ^ (words[:, k] & mask[k])) * _MIX
        key ^= key >> np.uint64(32)
    return key


def _run_mask(size: int) -> np.ndarray:
    return np.array([_ROUND >> 8 * (RUN - size)], np.uint64)


def run_words(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first RUN symbols behind each start, as one 64-bit word."""
    return points.take(starts[:, None] + np.arange(RUN), mode="clip").astype(np.uint8).view(np.uint64)


_FACTOR = 0xD6E8FEB86659FD93
_BACK = np.uint64(pow(_FACTOR, -1, 1 << 64))


def deletion_keys(read: np.ndarray, starts: np.ndarray, sizes: range) -> Iterator[np.ndarray]:
    """Hashes of the so many symbols behind each start, and of what is left when one of them goes: an array for each size and place."""
    total = [np.zeros(starts.size, np.uint64)]
    for k in range(sizes.stop - 1):
        symbol = read.take(starts + k, mode="clip").astype(np.uint64) + np.uint64(1)
        total.append(total[-1] + symbol * np.uint64(pow(_FACTOR, k, 1 << 64)))
    for size in sizes:
        yield _mixed(total[size], size)
        for k in range(size):
            yield _mixed(total[k] + (total[size] - total[k + 1]) * _BACK, size - 1)


def _mixed(key: np.ndarray, size: int) -> np.ndarray:
    key = (key ^ np.uint64(size)) * _MIX
    return (key ^ key >> np.uint64(29)) * _MIX


def item_keys(text: str) -> tuple[str, int, list[np.ndarray]]:
    """What is compared, the item's class, and its keys: arrays of table, key and start."""
    points, starts = joined(*word_runs(text))
    n, kind, found = points.size, class_of(points.size), []
    read = np.concatenate([symbols()[points], np.full(STEPS + RUN, SPACE, np.uint8)])
    if not kind:
        for size in range(1, RUN + 1):
            mine = starts[np.minimum(n + 1 - starts, RUN) == size]
            found.append((np.full(mine.size, size), _key(run_words(read, mine), _run_mask(size), size), mine))
        if n >= TINY.start:
            near = np.concatenate(list(deletion_keys(read, np.zeros(1, np.int64), range(n, n + 1))))
            found.append((np.zeros(near.size, np.int64), near, np.zeros(near.size, np.int64)))
    for w in range(WALKS if kind else 0):
        words = walk(read, starts, w, STEPS, ats := [])
        for t, mask in enumerate(masks()[kind]):
            inside = ats[np.flatnonzero(mask.view(np.uint8))[-1]] < n
            table = RUN + 1 + w * TABLES + t
            found.append((np.full(inside.sum(), table), _key(words[inside], mask, table), starts[inside]))
    return as_text(points), kind, [np.concatenate(x) for x in zip(*found, strict=True)]


def grams_of(read: np.ndarray) -> np.ndarray:
    """At each place the run of GRAM symbols that begins there, as a number below 2 ** GRAM_BITS."""
    g = read.astype(np.uint32)
    mixed = sum(g[k : g.size - GRAM + 1 + k] * np.uint32(m) for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[:GRAM]))
    return ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


def near_grams(text: str, room: int) -> np.ndarray:
    """For each ``BAND`` characters of where an item may lie: the grams that it has at most ``room`` away, a bit each."""
    grams = grams_of(symbols()[codes(text)]) if len(text) >= GRAM else np.empty(0, np.int32)
    bands = (len(text) + 2 * room + RUN + 2) // BAND + 1
    flags = np.zeros((bands, 1 << GRAM_BITS), bool)
    for b in range(bands):  # the part begins room + 1 characters before the item may
        first = b * BAND - room - 1
        flags[b, grams[max(0, first - room - RUN) : max(0, first + BAND + room)]] = True
    return np.packbits(flags, axis=1, bitorder="little")


def infix_distance(item: str, text: str) -> int:
    """Least edits between ``item`` and any part of ``text`` (bit-parallel dynamic programme)."""
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best = score
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (~(d | up) & full), up & d
        score += bool(plus & high) - bool(minus & high)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(x | plus) & full), plus & x
        best = min(best, score)
    return best


def least_edits(items: list[np.ndarray], of: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """A lower bound of the edits between item ``of`` and each row of ``texts``, from symbols modulo 64; 64 matches nothing.

    The same dynamic programme for all rows at once, in 64-bit words.
    """
    size = np.array([x.size for x in items])
    wide, one, top = -(-int(size.max()) // 64), np.uint64(1), np.uint64(63)
    equal = np.zeros((wide, 65, len(items)), np.uint64)
    for k, item in enumerate(items):
        place = np.arange(item.size)
        np.bitwise_or.at(equal, (place >> 6, item & 63, k), one << (place & 63).astype(np.uint64))
    equal = equal.reshape(wide, -1)
    up, down = np.full((wide, of.size), _ROUND, np.uint64), np.zeros((wide, of.size), np.uint64)
    score, last = size[of], ((size[of] - 1) & 63).astype(np.uint64)
    bottom = (size[of] - 1) // 64, np.arange(of.size)
    best = score.copy()
    for column in texts.T * np.int64(len(items)) + of:
        eq = equal.take(column, axis=1)
        both = eq & up
        total = both + up
        over = (total < both).astype(np.uint64)
        for k in range(1, wide):  # the carry from word to word
            total[k] += over[k - 1]
            over[k] |= total[k] < over[k - 1]
        across, x = (total ^ up) | eq, eq | down
        plus, minus = down | ~(across | up), up & across
        score += (plus[bottom] >> last & one).view(np.int64)
        score -= (minus[bottom] >> last & one).view(np.int64)
        np.minimum(best, score, out=best)
        shifted, lower = plus << one, minus << one
        shifted[1:] |= plus[:-1] >> top
        lower[1:] |= minus[:-1] >> top
        up, down = lower | ~(x | shifted), shifted & x
    return best


@dataclass
class Table:
    """The keys of one table, sorted, with item and start in it of each; and a filter of their upper bits."""

    keys: np.ndarray
    item: np.ndarray
    start: np.ndarray
    passes: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, item: np.ndarray, start: np.ndarray) -> Table:
        order = np.lexsort((start, item, keys))
        bits = max(16, min(24, int(keys.size).bit_length() + 4))
        passes = np.zeros(1 << bits, bool)
        passes[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        return cls(keys[order], item[order], start[order], passes)

    def meet(self, keys: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position in ``keys``, item and start of every equal pair, in pieces of bounded size."""
        at = np.flatnonzero(self.passes[(keys >> np.uint64(65 - self.passes.size.bit_length())).view(np.int64)])
        lo, hi = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        piece = np.cumsum(n) // most
        for k in range(int(piece[-1]) + 1 if n.size else 0):
            a, b, m = (x[piece == k] for x in (at, lo, n))
            pick = np.repeat(b - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(a, m), self.item[pick], self.start[pick]


class Index:
    """A block of items: what is compared, their trigrams, and their keys by table."""

    def __init__(self, similarity: float, ids: list, texts: list[str], kinds: np.ndarray, owner: np.ndarray, table: np.ndarray, key: np.ndarray, start: np.ndarray):
        self.ids, self.texts = ids, texts
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.room = np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        near = [near_grams(text, int(r)) for text, r in zip(texts, self.room, strict=True)]
        self.bands = np.cumsum([0, *map(len, near)])
        self.grams = np.concatenate([np.empty((0, 1 << GRAM_BITS - 3), np.uint8), *near]).ravel()
        kind = kinds[owner]
        words = np.bincount(np.unique(np.stack([owner, start]), axis=1)[0], minlength=len(texts)) if len(texts) else np.empty(0)
        self.many = (self.sizes >= MANY) & (words > 7)
        self.tables: dict[int, dict[int, Table]] = {}
        for k in np.unique(kind).tolist():
            mine = kind == k
            self.tables[k] = {t: Table.of(key[mine & (table == t)], owner[mine & (table == t)], start[mine & (table == t)]) for t in np.unique(table[mine]).tolist()}
        self.steps = max((span for least, _, span in CLASSES if least in self.tables), default=0)

    @classmethod
    def of(cls, items: list[tuple], similarity: float = SIMILARITY) -> Index:
        """Of (id, text) pairs that are at hand."""
        made = [(i, *item_keys(text)) for i, text in items if text and word_runs(text)[1].size]
        parts = [np.concatenate([x[3][j] for x in made] or [np.empty(0, np.int64)]) for j in range(3)]
        owner = np.repeat(np.arange(len(made)), [x[3][0].size for x in made])
        return cls(similarity, [x[0] for x in made], [x[1] for x in made], np.array([x[2] for x in made], np.int64), owner, parts[0], parts[1].astype(np.uint64), parts[2])

    def collisions(self, read: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Word of the text, item and start in it of every collision."""
        for first in range(0, places.size, PIECE):
            starts = places[first : first + PIECE]
            tiny = self.tables.get(0, {})
            for keys in deletion_keys(read, starts, range(TINY.start - 1, TINY.stop + 1)) if 0 in tiny else ():
                yield from ((first + a, i, s) for a, i, s in tiny[0].meet(keys))
            for size, table in tiny.items():
                yield from () if not size else ((first + a, i, s) for a, i, s in table.meet(_key(run_words(read, starts), _run_mask(size), size)))
            for w in range(WALKS if self.steps else 0):
                words = walk(read, starts, w, self.steps)
                for kind, tables in self.tables.items():
                    for t, mask in enumerate(masks()[kind] if kind else ()):
                        number = RUN + 1 + w * TABLES + t
                        if number in tables:
                            yield from ((first + a, i, s) for a, i, s in tables[number].meet(_key(words, mask, number)))

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, edits and first word of every item found; texts go through in batches of bounded size."""
        first = 0
        while first < len(texts):
            batch, total = [], 0
            while first + len(batch) < len(texts) and (total < BATCH_CHARS or not batch):
                batch.append(texts[first + len(batch)] or "")
                total += len(batch[-1])
            yield from ((first + t, i, e, s) for t, i, e, s in self._hits(batch))
            first += len(batch)

    def _hits(self, batch: list[str]) -> Iterator[tuple[int, int, int, int]]:
        points, starts, ends = word_runs("\n".join(batch))
        if not starts.size or not self.tables:
            return
        begins = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in batch)]))  # first word of each text
        points, places = joined(points, starts, ends)
        read = np.concatenate([symbols()[points], np.full(STEPS + RUN, SPACE, np.uint8)])
        edge = np.append(places, points.size + 1)[begins]  # first character of each text
        grams, best = grams_of(read), {}
        pairs = self._pairs(read, places, begins, edge)
        for k in range(0, pairs.size, PIECE):
            for i, t, low, high, begin in self._likely(pairs[k : k + PIECE], edge, grams, read):
                if best.get((t, i), (1, 0))[0]:
                    edits = infix_distance(self.texts[i], as_text(points[low:high]))
                    if edits <= self.room[i]:
                        word = max(0, int(np.searchsorted(places, begin, "right")) - 1 - int(begins[t]))
                        best[t, i] = min(best.get((t, i), (edits, word)), (edits, word))
        for (t, i), (edits, s) in best.items():
            yield t, i, edits, s

    def _pairs(self, read: np.ndarray, places: np.ndarray, begins: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where an item may begin, as one number: item, text, and slot of RUN characters (it may lie before the text).

        A place counts if words of the item that are ``FAR`` characters apart say so, give or take the edits
        that there may be; for small items one is enough.
        """
        slots, code, start = self._slots(edge) * RUN, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, item, begin in self.collisions(read, places):
            text = np.searchsorted(begins, at, "right") - 1
            code.append((item * np.int64(edge.size) + text) * slots + places[at] - begin - edge[text] + self._lead())
            start.append(begin)
        code, start = np.concatenate(code), np.concatenate(start)
        order = np.argsort(code, kind="stable")
        code, start = code[order], start[order]
        item = code // slots // edge.size
        new = np.ones(code.size, bool)  # a place is a run of begins that edits may have moved apart
        new[1:] = (code[1:] // slots != code[:-1] // slots) | (np.diff(code) > self.room[item[1:]])
        first = np.flatnonzero(new)
        if first.size:
            far = np.maximum.reduceat(start, first) - np.minimum.reduceat(start, first) >= FAR
            code = code[np.repeat(far, np.diff(np.append(first, code.size))) | ~self.many[item]]
        return np.unique(code // RUN)

    def _lead(self) -> int:
        return int(self.sizes.max())

    def _slots(self, edge: np.ndarray) -> np.int64:
        return np.int64((int(np.diff(edge).max()) + self._lead()) // RUN + 2)

    def _likely(self, pairs: np.ndarray, edge: np.ndarray, grams: np.ndarray, read: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Item, text, part of the text and likely begin of the places where grams and a lower bound of the edits let the item be."""
        slot, rest = pairs % self._slots(edge), pairs // self._slots(edge)
        text, item = rest % edge.size, rest // edge.size
        begin = slot * RUN - self._lead() + edge[text]
        size, room = self.sizes[item], self.room[item]
        start, end = begin - room - 1, begin + RUN + size + room + 1
        low, high = np.maximum(start, edge[text]), np.minimum(end, edge[text + 1] - 1)
        n = np.maximum(high - low, 0)
        first, at = np.cumsum(n) - n, np.arange(int(n.sum()))
        gram = grams[at + np.repeat(low - first, n)]
        row = np.repeat(self.bands[item], n) + (at + np.repeat(low - start - first, n)) // BAND
        seen = np.concatenate([[0], np.cumsum(self.grams[(row << GRAM_BITS - 3) + (gram >> 3)] >> (gram & 7).astype(np.uint8) & 1, dtype=np.int64)])
        likely = np.flatnonzero(seen[first + n] - seen[first] >= size - GRAM + 1 - GRAM * room)
        wide = np.minimum((size[likely] + 127) // 128, 3)  # items of similar size go through together
        for w in np.unique(wide).tolist():
            for part in np.array_split(mine := likely[wide == w], -(-mine.size // 2048)):
                some, of = np.unique(item[part], return_inverse=True)
                width = np.arange(int(n[part].max()))
                shown = np.where(width < n[part][:, None], read.take(low[part][:, None] + width, mode="clip") & 63, 64)
                for k in part[least_edits([symbols()[codes(self.texts[i])] for i in some.tolist()], of, shown) <= room[part]].tolist():
                    yield int(item[k]), int(text[k]), int(low[k]), int(high[k]), int(begin[k])


def indexes(benchmark: DataFrame, item_col: str, text_col: str, similarity: float) -> Iterator[Index]:
    """The items' keys, made on executors; a block at a time reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, made = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text and word_runs(text)[1].size:
                    keep.append(k)
                    made.append(item_keys(text))
            columns = [pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())]
            columns += [pa.array([x[2][j].view(np.int64) for x in made], pa.list_(pa.int64())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns], ["item_id", "plain", "kind", "table", "key", "start"])

    schema = f"item_id {id_type(benchmark, item_col)}, plain string, kind long, table array<long>, key array<long>, start array<long>"
    made = cut(benchmark.select(col(item_col).alias("item_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    words = made.agg(F.sum(F.regexp_count("plain", F.lit(" ")) + 1)).first()[0] or 0
    blocks = -(-words // BLOCK_ANCHORS)
    for block in range(blocks):
        rows = made.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).drop("row").toArrow()
        if rows.num_rows:
            table, key, start = (rows.column(c).combine_chunks() for c in ("table", "key", "start"))
            owner = np.repeat(np.arange(rows.num_rows), np.diff(table.offsets.to_numpy()))
            parts = [x.flatten().to_numpy(zero_copy_only=False) for x in (table, key, start)]
            yield Index(similarity, rows.column("item_id").to_pylist(), rows.column("plain").to_pylist(), rows.column("kind").to_numpy(), owner, parts[0], parts[1].view(np.uint64), parts[2])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, edits, similarity, first_word."""
    schema = f"doc_id {id_type(docs, id_col)}, item_id {id_type(benchmark, item_col)}, edits long, similarity double, first_word long"
    texts, out = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), None

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = list(index.hits(batch.column(1).to_pylist()))
                if rows:
                    at, item, edits, word = (np.array(x) for x in zip(*rows, strict=True))
                    ids = pa.array([index.ids[i] for i in item.tolist()])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids, pa.array(edits), pa.array(1 - edits / index.sizes[item]), pa.array(word)], ["doc_id", "item_id", "edits", "similarity", "first_word"])

        return run

    for index in indexes(benchmark, item_col, item_text_col, similarity):
        found = texts.mapInArrow(finder(docs.sparkSession.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows without any item, with all their columns; rows stream through, none are moved."""
    where = docs.columns.index(text_col)

    def cleaner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {t for t, _, _, _ in shared.value.hits(batch.column(where).to_pylist())}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        return run

    for index in indexes(benchmark, item_col, item_text_col, similarity):
        docs = docs.mapInArrow(cleaner(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
