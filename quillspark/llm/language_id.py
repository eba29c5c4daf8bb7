"""Language identification with string kernels.

Kernel: the blended-spectrum presence kernel - how many distinct n-grams of one to
three symbols two texts share, over the root of the product of their counts.
Symbols: a run of non-letters is one boundary; the most frequent letters of the
sample have a symbol each; other letters share symbols by Unicode block.
Nystroem: ``LANDMARKS`` sample texts span the feature space K_mm^(-1/2) k_m(x), in
which one ridge regression a language (one versus the rest) is fitted.  Scoring folds
both into one matrix; a batch of texts is a presence matrix over the landmarks'
n-grams, and two matrix products give all scores.

The sample is bounded: at most ``PER_LANGUAGE`` texts a language and ``SAMPLE`` in all,
each of at most ``TEXT_LIMIT`` characters, lowest hash of the id first.  It is drawn
from rows with a language that aren't held out.  Every whole text is scored.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without
any usable sample row every text is ``und``; ties go to the language first by code
point; repeated rows are scored alike; an empty table gives no rows; no input but the
text reaches a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm.codepoints import codes, folded, letters
from quillspark.llm.common import col, held_out, id_type

PER_LANGUAGE, SAMPLE, TEXT_LIMIT, LANDMARKS, RIDGE, OWN_LETTERS, CHUNK = 200, 4000, 20_000, 128, 0.1, 48, 1 << 20
UNKNOWN = "und"
_BITS = 6


def symbol_table(texts: list[str]) -> np.ndarray:
    """By code point: 0 for a non-letter, 1.. for the letters most frequent in the texts, then blocks of others."""
    low, is_letter = folded(), letters()
    counts: Counter = Counter()
    for text in texts:
        seen, n = np.unique(low[codes(text)], return_counts=True)
        counts.update({int(c): int(k) for c, k in zip(seen, n, strict=True) if c and is_letter[c]})
    points = np.arange(low.size, dtype=np.uint32)
    base = np.where(is_letter, np.where(low > 0, low, points), 0)
    table = np.where(is_letter, OWN_LETTERS + 1 + (base >> 7) % ((1 << _BITS) - OWN_LETTERS - 1), 0).astype(np.uint8)
    own = np.zeros(low.size, np.uint8)
    for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:OWN_LETTERS]):
        own[c] = k + 1
    return np.where(own[base] > 0, own[base], table)


def grams(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of the n-grams of one to three symbols, repeats included, in pieces of bounded size."""
    tail = np.zeros(1, np.int32)
    for k in range(0, len(text), CHUNK):
        symbols = np.concatenate([tail, table[codes(text[k : k + CHUNK])].astype(np.int32), np.zeros(int(k + CHUNK >= len(text)), np.int32)])
        symbols = symbols[np.concatenate([[True], (symbols[1:] > 0) | (symbols[:-1] > 0)])]
        pairs = symbols[:-1] << _BITS | symbols[1:]
        yield np.concatenate([symbols[symbols > 0], pairs + (1 << _BITS), (pairs[:-1] << _BITS | symbols[2:]) + (1 << 2 * _BITS) + (1 << _BITS)])
        tail = symbols[-2:]


SPACE = (1 << 3 * _BITS) + (1 << 2 * _BITS) + (1 << _BITS)


class Model:
    """A fitted classifier; small enough to travel with a task."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs, self.table = sorted(set(langs)), symbol_table(texts)
        by: dict[str, list[int]] = {}
        for k, lang in enumerate(langs):
            by.setdefault(lang, []).append(k)
        share = max(1, LANDMARKS // max(1, len(by)))
        marks = [k for lang in self.langs for k in by[lang][:share]]
        shown = np.stack([self._marks(texts[k]) for k in marks])
        self.used = np.flatnonzero(shown.any(axis=0))
        self.presence = shown[:, self.used].T.astype(np.float32)
        self.presence /= np.sqrt(self.presence.sum(axis=0, keepdims=True))
        del shown
        kernel = np.concatenate([self.kernel([self._marks(t)]) for t in texts]).astype(float)
        values, vectors = np.linalg.eigh(kernel[marks])
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = np.hstack([kernel @ root, np.ones((len(texts), 1))])
        wanted = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        weights = np.linalg.solve(features.T @ features + RIDGE * np.eye(features.shape[1]), features.T @ wanted)
        self.fold, self.bias = (root @ weights[:-1]).astype(np.float32), weights[-1].astype(np.float32)

    def _marks(self, text: str) -> np.ndarray:
        """Which n-grams a text has."""
        flags = np.zeros(SPACE, bool)
        for piece in grams(text, self.table):
            flags[piece] = True
        return flags

    def kernel(self, marked: list[np.ndarray]) -> np.ndarray:
        """Kernel values against every landmark: one product of a presence matrix."""
        counts = np.array([max(1, np.count_nonzero(m)) for m in marked], np.float32)
        return (np.stack([m[self.used] for m in marked]).astype(np.float32) @ self.presence) / np.sqrt(counts)[:, None]

    def predict(self, texts: list[str | None], rows: int = 64) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if t and self.has_letter(t)]
        for k in range(0, len(known), rows):
            part = known[k : k + rows]
            raw = self.kernel([self._marks(texts[i]) for i in part]) @ self.fold + self.bias
            best = raw.argmax(axis=1)
            scores[part] = np.clip((raw[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for i, b in zip(part, best.tolist(), strict=True):
                names[i] = self.langs[b]
        return names, scores

    def has_letter(self, text: str) -> bool:
        return any(self.table[codes(text[k : k + CHUNK])].any() for k in range(0, len(text), CHUNK))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on the bounded sample; None if no row can be learned from."""
    usable = docs.where(col(lang_col).isNotNull() & ~held_out(col(id_col)) & F.length(col(text_col)).between(1, TEXT_LIMIT))
    order = F.xxhash64(col(id_col).cast("string"))
    ranked = usable.select(col(id_col).alias("doc_id"), col(lang_col).cast("string").alias("lang"), F.row_number().over(Window.partitionBy(col(lang_col)).orderBy(order, col(id_col))).alias("nth"))
    chosen = ranked.where(F.col("nth") <= PER_LANGUAGE).orderBy("nth", "lang").limit(SAMPLE).select("doc_id", "lang").distinct()
    texts = usable.select(col(id_col).alias("doc_id"), col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()  # one text an id
    is_letter = letters()
    rows = [r for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])) if is_letter[codes(r["text"])].any()]
    return Model([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if shared.value is not None:
                names, scores = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text some language claims, or that has a letter where nothing can be learned from; rows stream through, none are moved."""
    shared, where = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        for batch in batches:
            texts = batch.column(where).to_pylist()
            if shared.value is not None:
                keep = [n != UNKNOWN for n in shared.value.predict(texts)[0]]
            else:
                keep = [bool(t) and any(is_letter[codes(t[k : k + CHUNK])].any() for k in range(0, len(t), CHUNK)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
