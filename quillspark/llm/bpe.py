"""Byte-level BPE by tree concatenation.

The vocabulary is that of the ``tokenizers`` library, read from a path that the caller
names; the library itself encodes what isn't cut any further.  Two trees concatenate:

* A *text* of more than ``SPAN`` code points is cut into halves, these into halves and so
  on, wherever that falls.  The pieces are dealt over tasks and encoded each by itself.  Neighbours
  are joined pairwise, level by level: a window around the join, from a split on its
  left on, is encoded again and grows until it has a split that the right side has too.
* A *word* - what the pre-tokenizer leaves unsplit - of more than ``LONG`` code points is cut
  into halves alike, all pieces are encoded in one batch, and all joins of a level
  re-encode windows of some tokens of either side in one batch, growing those
  that don't yet begin with a token of the left side and end with one of the right.

Both stop at exact agreement.  Words: a sequence of tokens is the encoding of its text
where every two neighbours are the encoding of theirs, as the first merge across their
border would happen between these two alone; windows that share a token with either side
prove all pairs.  Texts: matching goes on from a split alike whatever is before it, and what it
decides looks ahead less than ``MARGIN`` code points, which is the reach of a special string;
so splits that far from the end of a side, or of the window, are those of the whole text.

Defined cases: null and empty texts have no tokens; special strings in a text become their
ids, as the library's default is; nothing is cut off or padded; repeated rows
encode alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple
from unicodedata import ucd_3_2_0

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.llm.common import col, id_type

VOCABULARY = "byte_bpe_50k.json"
SPAN, LONG, MARGIN, CACHE, ROWS = 1 << 15, 256, 16, 1 << 18, 64
WINDOW, GROWTH = 32, 4
#: The pre-tokenizer's own pattern, a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+"
IDS = "array<int>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _settled(sign: str) -> bool:
    """Whether a character's class is as old as any table of classes, so that all of them agree on it."""
    return ucd_3_2_0.category(sign) != "Cn"


def _byte_of_sign() -> dict[str, int]:
    """The byte that each character of a vocabulary's pieces stands for: visible ones for themselves, the others from 256 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(visible))
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Coded(NamedTuple):
    """A stretch of text, encoded: where its words start (and its end), tokens before each (and all), and the tokens."""

    at: np.ndarray
    before: np.ndarray
    ids: np.ndarray


class Bpe:
    """A vocabulary with its pre-tokenizer, and the words met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core; Spark runs tasks side by side
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said["pre_tokenizer"] or {}
        plain = said["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"]) or any(len(s) > MARGIN - 3 for s in special):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern = regex.compile(WORDS.format(letter=r"\p{L}", digit=r"\p{N}"))
        self.ascii = re.compile(WORDS.format(letter="A-Za-z", digit="0-9"), re.ASCII)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        byte = _byte_of_sign()
        pieces = {k: bytes(byte[c] for c in piece) for piece, k in said["model"]["vocab"].items()} | {k: s.encode() for s, k in special.items()}
        self.bytes_of = [pieces.get(k, b"") for k in range(max(pieces) + 1)]
        self.length = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.known: dict[str, bytes] = {}  # the tokens of a word, four bytes each

    # words

    def words(self, text: str) -> list[str]:
        """What the pre-tokenizer splits a text into, special strings by themselves."""
        parts = self.cut.split(text) if self.cut and "<" in text else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part.isascii():
                out += self.ascii.findall(part)
            elif all(map(_settled, set(part))):
                out += self.pattern.findall(part)
            else:  # classes of younger characters are the library's own
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet."""
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        short = [w for w in fresh if len(w) <= LONG or w in self.special]
        self.known.update(zip(short, map(_packed, self._library(short)), strict=True))
        long = [w for w in fresh if len(w) > LONG and w not in self.special]
        self.known.update(zip(long, map(_packed, self.long_words(long)), strict=True))

    def long_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of words: pieces of all of them in one batch, then joins of neighbours, a level of all trees at a time."""
        pieces = [_halves(w) for w in words]
        coded = iter(self._library([p for parts in pieces for p in parts]))
        rows = [[next(coded) for _ in parts] for parts in pieces]
        while any(len(row) > 1 for row in rows):
            pairs = [(row[k], row[k + 1]) for row in rows for k in range(0, len(row) - 1, 2)]
            joined = iter(self._joined(pairs))
            rows = [[next(joined) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)] for row in rows]
        return [row[0] for row in rows]

    def _joined(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The tokens of both sides' text, for each pair: windows grow until both sides agree with them."""
        done: list = [None] * len(pairs)
        open_, reach = list(range(len(pairs))), 2
        while open_:
            spans = [self._window(*pairs[k], reach) for k in open_]
            coded = self._library([b"".join(self.bytes_of[t] for t in pairs[k][0][a:] + pairs[k][1][:b]).decode() for k, (a, b) in zip(open_, spans, strict=True)])
            for k, (a, b), ids in zip(open_, spans, coded, strict=True):
                left, right = pairs[k]
                if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                    done[k] = left[:a] + ids + right[b:]
            open_ = [k for k in open_ if done[k] is None]
            reach *= GROWTH
        return done

    def _window(self, left: list[int], right: list[int], reach: int) -> tuple[int, int]:
        """From which token of the left side and to which of the right, at whole characters."""
        inner = lambda t: 0x80 <= self.bytes_of[t][0] < 0xC0  # noqa: E731  begins within a character
        a, b = max(0, len(left) - reach), min(len(right), reach)
        while a and inner(left[a]):
            a -= 1
        while b < len(right) and inner(right[b]):
            b += 1
        return a, b

    # texts

    def coded(self, words: list[str], start: int = 0) -> Coded:
        """Words in order, as they are known."""
        found = list(map(self.known.__getitem__, words))
        at, before = (_sums(np.fromiter(map(len, x), np.int64, len(x))) for x in (words, found))
        return Coded(at + start, before // 4, np.frombuffer(b"".join(found), np.int32))

    def encode(self, texts: list[str]) -> list[Coded]:
        """Each text by itself."""
        return [self.coded(words) for words in self._learned(texts)]

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        """Only the tokens of each text."""
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in self._learned(texts)]

    def _learned(self, texts: list[str]) -> list[list[str]]:
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        return split

    def joined(self, text: str, left: Coded, right: Coded) -> Coded:
        """Both sides of a place of ``text``, each encoded by itself, as one stretch."""
        m, end, reach = int(right.at[0]), int(right.at[-1]), WINDOW
        while True:
            sure = left.at[(left.at <= m - MARGIN) & (left.at >= m - reach)]
            a = int(sure[0]) if sure.size else int(left.at[0]) if m - reach <= left.at[0] else -1
            stop = min(m + reach, end)
            if a >= 0:
                words = self.words(text[a:stop])
                self.learn(set(words))
                window = self.coded(words, a)
                both = np.intersect1d(window.at, right.at, assume_unique=True)
                both = both[(both <= stop - MARGIN) | (stop == end)]
                if both.size:
                    i, (j, k) = np.searchsorted(left.at, a), (np.searchsorted(x.at, both[0]) for x in (window, right))
                    tokens = left.before[i] + window.before[: j + 1], left.before[i] + window.before[j] + right.before[k + 1 :] - right.before[k]
                    return Coded(
                        np.concatenate([left.at[:i], window.at[: j + 1], right.at[k + 1 :]]), np.concatenate([left.before[:i], *tokens]),
                        np.concatenate([left.ids[: left.before[i]], window.ids[: window.before[j]], right.ids[right.before[k] :]]),
                    )
            reach *= GROWTH

    def concatenated(self, text: str, parts: list[Coded]) -> Coded:
        """Neighbouring stretches of a text, joined pairwise until one is left."""
        while len(parts) > 1:
            parts = [self.joined(text, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def decode(self, ids: np.ndarray) -> str:
        """What the tokens' bytes say; bytes that are no text become U+FFFD."""
        size = self.length[ids]
        first = np.repeat(self.start[ids] - np.cumsum(size) + size, size)
        return self.all_bytes[first + np.arange(first.size)].tobytes().decode("utf-8", "replace")


def _sums(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _halves(text: str, most: int = LONG) -> list[str]:
    """A text in 2^k parts of about the same length, of at most so many code points."""
    n = 1
    while -(-len(text) // n) > most:
        n *= 2
    edges = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def _column(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, len(batch), rows))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, ids.

    Texts of more than ``span`` code points go another way, piece by piece over all tasks.  ``path``: the
    vocabulary, readable on every executor; by default that of the installed package there.
    """
    kind = id_type(docs, id_col)
    given = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path or vocabulary_path())
        for batch in batches:
            for part in _slices(batch, ROWS):
                yield pa.RecordBatch.from_arrays([part.column(0), _column(bpe.tokens(part.column(1).to_pylist()))], ["doc_id", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = _halves(text, span)
                at = np.cumsum([0, *map(len, parts)])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), batch.column(0).type), pa.array([row] * len(parts), pa.int64()), pa.array(at, pa.int64()), pa.array(parts)], ["doc_id", "row", "at", "text"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path or vocabulary_path())
        for batch in batches:
            for part in _slices(batch, 1):
                c = bpe.encode(part.column(3).to_pylist())[0]
                yield pa.RecordBatch.from_arrays([*part.columns, *(_column([x.astype(np.int32)]) for x in (np.diff(c.at), np.diff(c.before), c.ids))], ["doc_id", "row", "at", "text", "sizes", "counts", "ids"])

    def tree(table: pa.Table) -> pa.Table:
        bpe = vocabulary(path or vocabulary_path())
        parts = table.sort_by("at")
        text = "".join(parts.column("text").to_pylist())
        coded = []
        for k, at in enumerate(parts.column("at").to_pylist()):
            sizes, counts, ids = (parts.column(c)[k].values.to_numpy() for c in ("sizes", "counts", "ids"))
            coded.append(Coded(at + _sums(sizes), _sums(counts), ids))
        return pa.table({"doc_id": parts.column(0).slice(0, 1), "ids": _column([bpe.concatenated(text, coded).ids])})

    short = given.where(F.length("text") <= span).mapInArrow(whole, f"doc_id {kind}, ids {IDS}")
    cut = given.where(F.length("text") > span).select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(pieces, f"doc_id {kind}, row long, at long, text string")
    leaves = cut.repartition("row", "at").mapInArrow(leaf, f"doc_id {kind}, row long, at long, text string, sizes {IDS}, counts {IDS}, ids {IDS}")
    return short.unionByName(leaves.groupBy("row").applyInArrow(tree, f"doc_id {kind}, ids {IDS}"))


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` (with ids) and a column decoded, special tokens included; an id that the vocabulary lacks is skipped, and null has no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path or vocabulary_path())
        for batch in batches:
            for part in _slices(batch, ROWS):
                lists = part.column("ids")
                values, ends = np.asarray(lists.values), np.asarray(lists.offsets)
                texts = []
                for k in range(len(part)):
                    ids = values[ends[k] : ends[k + 1]]
                    texts.append(bpe.decode(ids[(ids >= 0) & (ids < len(bpe.bytes_of))]) if lists[k].is_valid else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("decoded", StringType())]))
