"""Protected spans, placeholders, restoration and structural checks as operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import spans as S
from quillspark.functions.arrow import checked, once, scanner

MAP = "array<struct<ord:int,placeholder:string,original:string,nth:int>>"


def spans_of(md: Column) -> Column:
    return scanner(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in S.find_spans(t)], "array<struct<start:bigint,end:bigint,kind:string>>")(md)


def protected(md: Column, skip_inline_code: bool = False, most: int | None = S.MOST_PLACEHOLDERS, own: bool = False) -> Column:
    """struct<value struct<text, map>, error>; the map is an array in order of making.

    Beyond ``most`` spans of a kind there is an error; None protects however many, under names that repeat beyond 999.  Tokens like
    placeholders in the text are an error too; with ``own`` they are listed behind the others, with a null original.
    """

    def run(text: str) -> dict:
        out, kept = S.protect_every(text, skip_inline_code, most, own)
        return {"text": out, "map": [{"ord": k, **e._asdict()} for k, e in enumerate(kept, 1)]}

    return checked(run, f"struct<text:string,map:{MAP}>", S.SpanError)(md)


def restored(text: Column, entries: Column, strict: bool = True) -> Column:
    """struct<value, error>."""
    run = lambda t, e: S.restore_every(t, [S.Kept(x["placeholder"], x["original"], x["nth"]) for x in e], strict)
    return checked(run, "string", S.SpanError)(text, entries)


def structure_warnings(original: Column, rewritten: Column) -> Column:
    return scanner(S.structure_warnings, "array<string>")(original, rewritten)


def url_targets(md: Column) -> Column:
    return scanner(S.url_targets, "array<string>")(md)


def math_delimiters(md: Column) -> Column:
    return scanner(lambda t: list(S.math_delimiters(t)), "array<int>")(md)


def protected_spans(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, start, end, kind of every span of the raw text."""
    return docs.select(F.col(id_col), once(spans_of(F.col(md_col))).alias("spans")).select(id_col, F.explode("spans").alias("s")).select(id_col, "s.start", "s.end", "s.kind")


def protect(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md", skip_inline_code: bool = False, most: int | None = None, own: bool = False) -> DataFrame:
    """doc_id, protected_text, map, error; however many spans a text has, unless ``most`` limits those of a kind."""
    rows = docs.select(F.col(id_col), once(protected(F.col(md_col), skip_inline_code, most, own)).alias("p"))
    return rows.select(id_col, F.col("p.value.text").alias("protected_text"), F.col("p.value.map").alias("map"), F.col("p.error").alias("error"))


def restore(protected_docs: DataFrame, id_col: str = "doc_id", strict: bool = True) -> DataFrame:
    """doc_id, text, error from doc_id, protected_text, map."""
    rows = protected_docs.select(F.col(id_col), once(restored(F.col("protected_text"), F.col("map"), strict)).alias("r"))
    return rows.select(id_col, F.col("r.value").alias("text"), F.col("r.error").alias("error"))


def placeholder_faults(texts: DataFrame, maps: DataFrame, key: str = "doc_id") -> DataFrame:
    """Relational check of placeholders: key, placeholder, fault (missing, duplicated, unknown).

    ``texts``: key, text.  ``maps``: key, placeholder.
    """
    seen = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"(?<![_A-Za-z0-9])__[A-Z][A-Z_]*_[0-9]{3}__"), F.lit(0))).alias("placeholder"))
    counts = seen.groupBy(key, "placeholder").agg(F.count(F.lit(1)).alias("n"))
    met = maps.select(key, "placeholder", F.lit(True).alias("known")).join(counts, [key, "placeholder"], "full")
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicated")
    return met.withColumn("fault", fault).where("fault IS NOT NULL").select(key, "placeholder", "fault")
