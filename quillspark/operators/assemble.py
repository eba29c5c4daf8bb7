"""Translated chunks to one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import columns as C


def merge_translations(chunks: DataFrame, translations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, body: translations in order, each with its chunk's last separator; null if one is missing.

    ``chunks``: id, idx, separators.  ``translations``: id, idx, text.
    """
    met = chunks.select(id_col, "idx", "separators").join(translations.select(id_col, "idx", "text"), [id_col, "idx"], "left")
    last = F.coalesce(F.try_element_at("separators", F.lit(-1)), F.lit(""))
    bare = F.when(F.endswith("text", last), F.left("text", F.length("text") - F.length(last))).otherwise(F.col("text"))  # a separator may end with the next line's indentation
    piece = F.when(last != "", F.concat(F.rtrim(bare, F.lit("\n")), last)).otherwise(F.col("text"))
    rows = met.withColumn("piece", piece).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "piece"))).alias("p"), F.bool_and(F.col("piece").isNotNull()).alias("whole"))
    return rows.select(id_col, F.when(F.col("whole"), F.array_join(F.transform("p", lambda p: p["piece"]), "")).alias("body"))


def assembled(title: Column, meta: Column, outline: Column, glossary: Column, body: Column) -> Column:
    """Title, meta, outline, glossary and body with blank lines between; headings get lines of their own."""
    parts = [F.trim(p, F.lit("\n")) for p in (C.title_line(title), meta, C.outline_section(outline), C.glossary_section(glossary), body)]
    return C.heading_collisions(F.concat(F.regexp_replace(F.concat_ws("\n\n", *parts), r"(?U)\s+$", ""), F.lit("\n")))
