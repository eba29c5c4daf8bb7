"""Text files, address lists and written documents."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import columns as C
from quillspark.operators.lineage import numbered


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, source_type, source_value, title_hint, md: one row a file, whole and UTF-8.  A missing path fails on the driver."""
    if not paths or not all(paths):
        raise ValueError("input path is required")
    rows = spark.read.text(paths, wholetext=True).withColumn("source_value", F.input_file_name())
    hint = F.regexp_extract("source_value", "[^/]*$", 0)
    return rows.select(F.xxhash64("source_value").alias("doc_id"), F.lit("file").alias("source_type"), "source_value", hint.alias("title_hint"), F.col("value").alias("md"))


def url_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """list_no, line_no, url of all lists in order, duplicates kept; blank and # lines left out."""
    if not paths:
        raise ValueError("no URLs provided")
    out = None
    for k, path in enumerate(paths, 1):
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(C.lines(F.col("value"))).alias("line_no", "line"))
        one = rows.select(F.lit(k).alias("list_no"), (F.col("line_no") + 1).cast("long").alias("line_no"), C.strip(F.col("line")).alias("url"))
        out = one if out is None else out.unionByName(one)
    return out.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def batch_paths(urls: DataFrame, order: tuple[str, ...] = ("list_no", "line_no"), url_col: str = "url") -> DataFrame:
    """``urls`` with idx (from 1, over all in order) and out_name; numbers have three digits or more, so names differ."""
    number = F.when(F.col("idx") < 1000, F.lpad(F.col("idx").cast("string"), 3, "0")).otherwise(F.col("idx").cast("string"))
    return numbered(urls, "idx", *order).withColumn("out_name", F.concat(number, F.lit("-"), C.url_slug(F.col(url_col)), F.lit(".md")))


def atomic_write_text(path: str, content: str) -> None:
    """One file: written beside its place, then moved there; line ends stay newlines."""
    folder = os.path.dirname(os.path.abspath(path))
    if not path:
        raise ValueError("output path is required")
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"output directory does not exist: {folder}")
    handle, draft = tempfile.mkstemp(prefix=".tmp-", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(content)
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise


def write_files(docs: DataFrame, out_dir: str, name_col: str = "out_name", text_col: str = "text") -> DataFrame:
    """out_name, n_chars, error of one file a row, written by the executors into a folder that all share."""
    rows = docs.select(F.col(name_col).alias("out_name"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if text is None:
                        raise ValueError("no text")
                    atomic_write_text(os.path.join(out_dir, os.path.basename(name)), text)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            sizes = pa.array([len(t) if t is not None else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(errors, pa.string())], ["out_name", "n_chars", "error"])

    return rows.mapInArrow(run, "out_name string, n_chars long, error string")
