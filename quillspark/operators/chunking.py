"""Documents to ordered chunks and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import chunks as K
from quillspark.functions.arrow import checked, once, scanner

CHUNKS = "array<struct<chunk_id:string,source_text:string,separators:array<string>>>"


def plan_of(md: Column, most: int = K.DEFAULT_CHARS) -> Column:
    """struct<value array<chunk>, error>."""
    return checked(lambda t: [c._asdict() for c in K.plan(t, most)], CHUNKS, K.PlanError)(md)


def chunk_plan(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md", most: int = K.DEFAULT_CHARS) -> DataFrame:
    """doc_id, idx (from 0), chunk_id, source_text, separators; a document without a plan has one row with error."""
    rows = docs.select(F.col(id_col), once(plan_of(F.col(md_col), most)).alias("p")).where("p.error IS NOT NULL OR size(p.value) > 0")
    out = rows.select(id_col, F.col("p.error").alias("error"), F.posexplode_outer("p.value").alias("idx", "c"))
    return out.select(id_col, F.col("idx").cast("long").alias("idx"), "c.chunk_id", "c.source_text", "c.separators", "error")


def reconstruct(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "source_text") -> DataFrame:
    """doc_id, md: the chunks' texts in order of idx."""
    rows = chunks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", F.col(text_col).alias("t")))).alias("c"))
    return rows.select(id_col, F.array_join(F.transform("c", lambda c: c["t"]), "").alias("md"))


def chunk_payload(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, payload: the plan as JSON."""
    rows = chunks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "chunk_id", "source_text", "separators"))).alias("c"))
    return rows.select(id_col, F.to_json(F.transform("c", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["source_text"].alias("source_text"), c["separators"].alias("separators")))).alias("payload"))


def parse_chunk_payload(payloads: DataFrame, id_col: str = "doc_id", json_col: str = "payload") -> DataFrame:
    """doc_id, idx, chunk_id, source_text, separators, error from JSON arrays of strings or of objects."""
    v = F.try_parse_json(F.col(json_col))
    kind = F.schema_of_variant(v)
    item = "struct<chunk_id:string,source_text:string,separators:array<string>>"
    texts, objects = F.from_json(F.col(json_col), "array<string>"), F.from_json(F.col(json_col), f"array<{item}>")
    plain = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    whole = F.forall(objects, lambda c: c["chunk_id"].isNotNull() & c["source_text"].isNotNull() & c["separators"].isNotNull() & F.forall(c["separators"], lambda s: s.isNotNull()))
    error = F.when(v.isNull() | ~kind.startswith("ARRAY"), "chunks must be a JSON array").when(~plain & ~kind.startswith("ARRAY<OBJECT"), "chunks must be a JSON array of objects").when(
        ~plain & ~F.coalesce(whole, F.lit(False)), "chunk items must include chunk_id, source_text, and separators"
    )
    numbered = F.transform(texts, lambda t, k: F.struct(F.format_string("chunk-%04d", k + 1).alias("chunk_id"), t.alias("source_text"), F.array().cast("array<string>").alias("separators")))
    rows = payloads.select(F.col(id_col), error.alias("error"), F.when(error.isNull(), F.when(plain, numbered).otherwise(objects)).alias("c"))
    return rows.select(id_col, "error", F.posexplode_outer("c").alias("idx", "x")).select(id_col, F.col("idx").cast("long").alias("idx"), "x.chunk_id", "x.source_text", "x.separators", "error")


def sentence_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = K.DEFAULT_CHARS) -> DataFrame:
    """doc_id, idx (from 0), piece: each text, taken as one paragraph, in parts of at most ``most`` characters."""
    parts = scanner(lambda t: [p for p, _ in K.pieces(t, "", most)], "array<string>")(F.col(text_col))
    return docs.select(F.col(id_col), once(parts).alias("parts")).select(id_col, F.posexplode("parts").alias("idx", "piece")).select(id_col, F.col("idx").cast("long").alias("idx"), "piece")


def chunk_units(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md", most: int = K.DEFAULT_CHARS) -> DataFrame:
    """doc_id, section (from 0), unit (from 1), size, error: the pieces of which chunks are packed; ``intervals.packed`` packs them by document and section."""
    pieces = checked(lambda t: [{"section": s, "unit": k, "size": n} for s, k, n in K.units(t, most)], "array<struct<section:bigint,unit:bigint,size:bigint>>", K.PlanError)(F.col(md_col))
    rows = docs.select(F.col(id_col), once(pieces).alias("p")).where("p.error IS NOT NULL OR size(p.value) > 0")
    return rows.select(id_col, F.col("p.error").alias("error"), F.explode_outer("p.value").alias("u")).select(id_col, "u.section", "u.unit", "u.size", "error")


def heading_sections(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, line_no, section: number of the heading section a line stands in; ``lines`` also has in_span.

    A running count over a document's lines.
    """
    heads = F.col("line").rlike(r"^[ \t]{0,3}#{1,6}[ \t]+") & ~F.col("in_span")
    order = Window.partitionBy(id_col).orderBy("line_no")
    return lines.select(id_col, "line_no", F.sum(F.when(heads & (F.col("line_no") > 1), 1).otherwise(0)).over(order).cast("long").alias("section"))
