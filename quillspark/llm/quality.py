"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins at quantiles of the sample.  Boosting goes
round the features in a fixed cycle; each step fits a shallow tree (at most ``LEAVES``
leaves) to the gradient over the bins of one feature and adds a small multiple of it to
that feature's lookup table.  Then the ``PAIRS`` pairs of features that explain most of
what is left are boosted likewise, with trees of two crossing splits.  A score is the
logistic of an intercept and one looked-up value per table: additions of bins.

The sample is bounded: at most ``SAMPLE`` labelled rows, lowest hash of the id first, of
those that aren't held out.  Every whole text is scored.

Defined cases: null counts as empty, and empty texts are scored like any other; rows
without a label teach nothing; with no label at all every score is 0.5, with one class
only it is the smoothed share of label 1; repeated rows are scored alike; an empty
table gives no rows; no input but the text reaches a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import col, held_out, id_type

SAMPLE, BINS, PAIR_BINS, LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST, THRESHOLD = 8000, 32, 8, 3, 150, 60, 5, 0.15, 8, 0.7
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "stops", "pipes", "bangs", "wide", "distinct_words", "top_word", "repeated_next", "same_lines", "line_words", "short_words", "marked_words",
)


def _kinds() -> np.ndarray:
    """By byte: 0 letter, 1 upper case, 2 digit, 3 white space, 4 . or , 5 | 6 ! or ? 7 other symbol, 8 beyond ASCII."""
    kinds = np.full(256, 7, np.intp)
    kinds[128:] = 8
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\x0b\x0c", 3), (b".,", 4), (b"|", 5), (b"!?", 6)):
        kinds[list(chars)] = kind
    return kinds


KINDS = _kinds()


def features(text: str | None) -> list[float]:
    """The values of FEATURES for one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, m = max(1, len(data)), max(1, len(words))
    of = np.zeros(9)
    for k in range(0, len(data), 1 << 20):
        of += np.bincount(KINDS[np.frombuffer(data[k : k + (1 << 20)], np.uint8)], minlength=9)
    counts, lines = Counter(words), [x for x in data.split(b"\n") if x.strip()]
    letters = max(1.0, of[0] + of[1] + of[8])
    next_same = sum(map(bytes.__eq__, words, words[1:]))
    sample = max(1, min(m, 200))
    distinct = np.mean([len(set(words[k : k + sample])) / len(words[k : k + sample]) for k in range(0, m, sample)]) if words else 1.0
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / m, of[1] / letters, of[2] / n, of[7] / n, of[4] / n, of[5] / m, of[6] / m, of[8] / n,
        float(distinct), max(counts.values(), default=0) / m, next_same / m, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))),
        sum(len(w) <= 3 for w in words) / m, sum(w[-1] in b"#$%&*!|" for w in words) / m,
    ]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values by bin of a shallow tree on the sums of gradient, curvature and rows of each bin."""
    leaves = [(0, g.size)]
    while len(leaves) < LEAVES:
        best = (1e-9, None)
        for k, (a, b) in enumerate(leaves):
            cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            fits = np.flatnonzero((cn[:-1] >= LEAST) & (cn[-1] - cn[:-1] >= LEAST))
            if fits.size:
                gains = _gain(cg[fits], ch[fits]) + _gain(cg[-1] - cg[fits], ch[-1] - ch[fits]) - _gain(cg[-1], ch[-1])
                i = int(gains.argmax())
                if gains[i] > best[0]:
                    best = (gains[i], (k, a + int(fits[i]) + 1, b))
        if best[1] is None:
            break
        k, cut, b = best[1]
        leaves[k : k + 1] = [(leaves[k][0], cut), (cut, b)]
    out = np.empty(g.size)
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _crossing(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of splits, one on each axis."""
    total, best = _gain(g.sum(), h.sum()), (0.0, np.zeros_like(g))
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            hs = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            if (gain := float(_gain(gs, hs).sum() - total)) > best[0] + 1e-12:
                values, (a, b, c, d) = np.empty_like(g), gs / (hs + 1.0)
                values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = a, b, c, d
                best = (gain, values)
    return best


class Model:
    """Cut points and lookup tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        wide = x.shape[1] if len(y) else 0
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], grid)) for f in range(wide)]
        self.coarse = [c[np.unique(np.linspace(0, c.size - 1, PAIR_BINS - 1).astype(int))] for c in self.cuts]
        self.tables, self.pairs, self.pair_tables = [np.zeros(c.size + 1) for c in self.cuts], [], []
        if not len(y) or y.min() == y.max():
            return
        bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
        score = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                p = _logistic(score)
                size = self.tables[f].size
                step = RATE * _tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), np.bincount(b, minlength=size))
                self.tables[f] += step
                score += step[b]
        small = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.coarse)]

        def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
            shape = self.coarse[f].size + 1, self.coarse[g].size + 1
            at, p = small[f] * shape[1] + small[g], _logistic(score)
            return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

        ranked = sorted(((_crossing(*sums(f, g))[0], f, g) for f in range(wide) for g in range(f)), reverse=True)
        self.pairs = [(f, g) for gain, f, g in ranked[:PAIRS] if gain > 0]
        self.pair_tables = [np.zeros((self.coarse[f].size + 1, self.coarse[g].size + 1)) for f, g in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (f, g) in enumerate(self.pairs):
                step = RATE * _crossing(*sums(f, g))[1]
                self.pair_tables[k] += step
                score += step[small[f], small[g]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Bin every feature, then add what the tables hold."""
        total = np.full(len(x), self.start)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return _logistic(total)


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the bounded sample; executors compute the features, only these reach the driver."""
    marked = labels.select(col(id_col).alias("doc_id"), col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = marked.join(docs.select(col(id_col).alias("doc_id")), "doc_id", "left_semi")
    chosen = known.distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(run, f"doc_id {id_type(docs, id_col)}, label int, x array<double>")
    rows = met.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()  # one text an id and label
    order = sorted((r["label"], *r["x"]) for r in rows)
    table = np.array(order, float).reshape(-1, 1 + len(FEATURES))
    return Model(table[:, 1:], table[:, 0])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, held_out boolean, score double, predicted int")
