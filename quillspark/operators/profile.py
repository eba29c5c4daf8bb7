"""Profiles of documents: parsing, completion and rendering, with the first broken rule in an error column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import profiles as R
from quillspark.functions.arrow import checked, once

OUTLINE = "array<struct<level:int,heading:string,summary_bullets:array<string>,key_takeaways:array<string>>>"
GLOSSARY = "array<struct<term_en:string,term_zh:string,note_zh:string,keep_en_on_first_use:boolean>>"
DOC = "struct<title:string,source:struct<type:string,value:string>,language:struct<source:string,target:string>>"
STYLE = "struct<tone:string,annotation_density:string,rules:array<string>>"
PROFILE = f"struct<doc:{DOC},outline:{OUTLINE},glossary:{GLOSSARY},style_guide:{STYLE},markdown:string>"


def parsed(response: Column, source_type: Column, source_value: Column, title_hint: Column) -> Column:
    """struct<value profile with its markdown, error>."""

    def run(text: str, kind: str, value: str, hint: str) -> dict:
        found = R.complete(R.parse(text), kind, value, hint or None)
        return found | {"markdown": R.render(found)}

    return checked(run, PROFILE, R.ProfileError)(response, source_type, source_value, F.coalesce(title_hint, F.lit("")))


def profiles(responses: DataFrame) -> DataFrame:
    """doc_id, profile, error from doc_id, response, source_type, source_value, title_hint."""
    rows = responses.select("doc_id", once(parsed(F.col("response"), F.col("source_type"), F.col("source_value"), F.col("title_hint"))).alias("p"))
    return rows.select("doc_id", F.col("p.value").alias("profile"), F.col("p.error").alias("error"))


def document_title(profile_title: Column, title_hint: Column, source_value: Column) -> Column:
    """The profile's title, the hint, the last part of the source, or Document."""
    blank = lambda c: F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit(""))
    base = F.nullif(F.regexp_extract(F.coalesce(source_value, F.lit("")), "[^/]*$", 0), F.lit(""))
    return F.coalesce(blank(profile_title), F.nullif(title_hint, F.lit("")), base, F.lit("Document"))
