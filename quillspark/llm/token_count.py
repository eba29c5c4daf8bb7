"""Token counts by rank-synchronous array merging.

The vocabulary is a sentencepiece BPE model with byte fallback, read from a path that
the caller names.  No piece has a space mark behind another character, so a text
falls apart before each run of marks, and pre-tokens merge independently.  Pre-tokens
that a task hasn't met yet are held together as one ragged array of symbols.  In each
round every pre-token finds its best-ranked pair (highest score, then leftmost) and
applies it, all at once, until no pair is left; the surviving symbols are counted,
those outside the vocabulary as their UTF-8 bytes.  A cache of bounded size remembers
the counts of pre-tokens.  Pre-tokens longer than ``LONG`` characters merge one at a
time through a heap, whose time hardly grows faster than their length.

Defined cases: null and empty texts have 0 tokens; special strings are ordinary text,
as the library takes them by default; nothing is cut or padded; repeated rows count
alike; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import col, id_type

MARK, LIMIT, LONG, CACHE, GROUP = "▁", 4096, 192, 1 << 20, 1 << 14
MODEL = "piece_bpe_32k.model"
_PIECE = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NORMAL = 1
_NONE = np.int64(1 << 62)


def model_path(name: str = MODEL) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pair tables of a model: for two symbols, the symbol that they merge into and its rank."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, rules = model.normalizer_spec, model.trainer_spec
        plain = normal.name == "identity" and not normal.remove_extra_whitespaces and normal.escape_whitespaces and normal.add_dummy_prefix
        if not (plain and rules.byte_fallback and rules.model_type == 2 and all(p.type in (1, 2, 3, 6) for p in model.pieces)):
            raise ValueError("not a plain BPE model with byte fallback")
        scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in scores):
            raise ValueError("a piece has a space mark behind another character")
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.symbols = {p: k for k, p in enumerate(scores)}
        for piece in scores:
            for c in piece:
                self.symbols.setdefault(c, len(self.symbols))
        names = list(self.symbols)
        self.other = len(names)  # characters in no piece: never merge
        self.cost = np.array([1 if p in scores else len(p.encode("utf-8", "surrogatepass")) for p in names] + [0], np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, score in scores.items():
            for k in range(1, len(piece)):
                a, b = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = order[score], self.symbols[piece]
        keys = np.array([a * (self.other + 1) + b for a, b in self.pairs], np.int64)
        found = np.array(list(self.pairs.values()), np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[by], found[by, 0], found[by, 1]
        self.cache: dict[str, int] = {}

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; a rank past all others where the pair doesn't merge."""
        key = a * (self.other + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        is_pair = self.keys[at] == key
        return np.where(is_pair, self.ranks[at], _NONE), self.merged[at]

    def merge_all(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all merging at the same time."""
        total = np.zeros(len(words), np.int64)
        text = "".join(words)
        get, other = self.symbols.get, self.other
        symbols = np.fromiter((get(c, other) for c in text), np.int64, len(text))
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        strange = np.flatnonzero(symbols == other)
        if strange.size:
            np.add.at(total, owner[strange], [len(text[k].encode("utf-8", "surrogatepass")) for k in strange.tolist()])
        rank, into = np.full(symbols.size, _NONE), np.zeros(symbols.size, np.int64)
        if symbols.size > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same], into[same] = self.look_up(symbols[same], symbols[same + 1])
        while symbols.size:
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, first)
            run = np.diff(np.concatenate([first, [symbols.size]]))
            alive = best < _NONE
            keep = np.repeat(alive, run)
            done = ~keep
            if done.any():  # finished pre-tokens leave the array
                np.add.at(total, owner[done], self.cost[symbols[done]])
                symbols, owner, rank, into, best, run = symbols[keep], owner[keep], rank[keep], into[keep], best[alive], run[alive]
                if not symbols.size:
                    break
            hit = np.flatnonzero(rank == np.repeat(best, run))
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]  # the leftmost of each
            symbols[hit] = into[hit]
            stay = np.ones(symbols.size, bool)
            stay[hit + 1] = False
            at = np.cumsum(stay)[hit] - 1  # where the merged symbols are afterwards
            symbols, owner = symbols[stay], owner[stay]
            rank, into = rank[stay], into[stay]
            for k in (at, at[at > 0] - 1):
                inside = k[k + 1 < symbols.size]
                inside = inside[owner[inside] == owner[inside + 1]]
                rank[k] = _NONE
                rank[inside], into[inside] = self.look_up(symbols[inside], symbols[inside + 1])
        return total

    def merge_one(self, word: str) -> int:
        """Tokens of one long pre-token: the same merges in the same order, through a heap."""
        symbols = [self.symbols.get(c, self.other) for c in word]
        strange = sum(len(c.encode("utf-8", "surrogatepass")) for c, s in zip(word, symbols, strict=True) if s == self.other)
        n = len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(k: int) -> None:
            if 0 <= k and after[k] < n and (found := self.pairs.get((symbols[k], symbols[after[k]]))):
                heapq.heappush(heap, (found[0], k, symbols[k], symbols[after[k]], found[1]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, a, b, into = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != a or j >= n or symbols[j] != b:
                continue
            symbols[k], symbols[j], after[k] = into, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
            offer(k)
            offer(before[k])
        return strange + int(self.cost[[s for s in symbols if s >= 0]].sum())

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        cut = [_PIECE.findall(f"{MARK}{t}".replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        fresh = sorted({w for words in cut for w in words if w not in cache}, key=len)
        short = [w for w in fresh if len(w) <= LONG]
        for k in range(0, len(short), GROUP):
            part = short[k : k + GROUP]
            cache.update(zip(part, self.merge_all(part).tolist(), strict=True))
        long = {w: self.merge_one(w) for w in fresh[len(short) :]}
        return [sum(long[w] if len(w) > LONG else cache[w] for w in words) if long else sum(map(cache.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``path``: the model's file, readable on every executor; by default that of the installed package there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path or model_path())
        for batch in batches:
            texts, tokens = batch.column(1).to_pylist(), []
            for k in range(0, len(texts), 256):
                tokens += vocab.count(texts[k : k + 256])
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean")
