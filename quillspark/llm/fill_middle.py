"""Fill-in-the-middle transformation over code point arrays.

A text is decoded to an array of UTF-32 code points.  Its units are runs of A-Z and
a-z, and single code points of any other kind; a unit starts wherever two neighbours
aren't both such letters, so one comparison of the array with itself and one
``flatnonzero`` give every boundary.  Two boundaries are chosen by rank from a hash of
the document's id, the array is sliced there, and the pieces are encoded again.

Defined cases: null and empty texts, and texts that hold a mark of the format, stay
plain; a null id hashes like an empty one; the two boundaries may be equal or lie at
the ends, and then pieces are empty; repeated rows give equal rows; an empty table
gives no rows; other columns are ignored.  A text stays in one task, as its row does,
at four bytes a code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.codepoints import codes
from quillspark.llm.common import col, id_type

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rates:
    """Of 100 texts: ``changed`` get a form, ``suffix_first`` of 100 of these begin with the suffix."""

    changed: int = 90
    suffix_first: int = 20
    seed: int = 1


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where units start, and the end of the last one."""
    lower = points | 0x20
    letter = (lower >= 97) & (lower <= 122)
    starts = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], starts, [points.size]]) if points.size else np.zeros(1, np.int64)


def hashes(doc_id: object, seed: int) -> list[int]:
    """Four 32-bit numbers from the id."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def rearrange(text: str, h: list[int], rates: Rates = Rates()) -> tuple[int, str, int | None, int | None, str]:
    """Units of the text, its form, code points of prefix and middle (None where plain), and the output."""
    points = codes(text)
    at = boundaries(points)
    n = at.size - 1
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rates.changed:
        return n, "plain", None, None, text
    a, b = (int(at[r]) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = _text(points[:a]), _text(points[a:b]), _text(points[b:])
    if h[3] % 100 < rates.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates()) -> DataFrame:
    """One row per document: doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            done = list(zip(*(rearrange(text or "", hashes(key, rates.seed), rates) for key, text in rows), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, done, kinds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, {OUT}")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, as a column; no piece holds a mark, so each mark is where it first stands."""
    whole = F.col(output)
    first = F.when(F.col(form) == "psm", F.substring_index(whole, SUFFIX, 1)).otherwise(F.substring_index(whole, PREFIX, 1))
    rest = F.substring(whole, F.length(first) + len(PREFIX) + 1, F.length(whole))
    second = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(second) + len(MIDDLE) + 1, F.length(rest))
    opened = F.substring(first, F.lit(len(PREFIX) + 1), F.length(first))
    return F.when(F.col(form) == "plain", whole).when(F.col(form) == "psm", F.concat(opened, middle, second)).otherwise(F.concat(second, middle, opened))
