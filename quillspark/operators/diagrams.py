"""Diagrams embedded in pages: extraction as events with an as-of heading, conversion by content, insertion."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import columns as C, diagrams as D
from quillspark.functions.arrow import once, scanner

EVENTS = "array<struct<pos:bigint,kind:string,text:string>>"
DIAGRAM = "struct<language:string,content:string,heading:string>"


#: Character references as patterns and what they stand for.
References = tuple[tuple[str, str], ...]


def page_events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", references: References | None = None) -> DataFrame:
    """page_id, pos, kind (heading or diagram), text; entities need Python's full table, unless ``references`` says which a heading's are."""
    return pages.select(F.col(id_col), once(scanner(partial(D.page_events, references=references), EVENTS)(F.col(html_col))).alias("events")).select(id_col, F.explode("events").alias("e")).select(id_col, "e.pos", "e.kind", "e.text")


def nearest_heading(events: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Each event that isn't a heading with the last heading before it: an as-of join as a window."""
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(before)
    return events.withColumn("heading", heading).where("kind <> 'heading'")


def extract_diagrams(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", references: References | None = None) -> DataFrame:
    """page_id, pos, language, content, heading; ``references`` as in ``page_events``."""
    return nearest_heading(page_events(pages, id_col, html_col, references), id_col).select(id_col, "pos", F.lit("snapdown").alias("language"), F.col("text").alias("content"), "heading")


def html_headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, ord (from 1), level, heading: tags out, white space squeezed; entities stay.  No Python."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = pages.select(F.col(id_col), F.posexplode(found).alias("at", "h"))
    return rows.select(id_col, (F.col("at") + 1).cast("long").alias("ord"), F.substring("h", 3, 1).cast("int").alias("level"), C.squeeze(C.strip_tags(F.col("h"))).alias("heading"))


def scripts_asof_heading(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, ord (from 1), n_chars, heading of every script element, with the last heading before it.  No Python."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<script\b[^>]*>.*?</script>|<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = pages.select(F.col(id_col), F.posexplode(found).alias("pos", "x"))
    is_heading = F.col("x").rlike("(?i)^<h[1-6]")
    events = rows.select(id_col, "pos", "x", F.when(is_heading, "heading").otherwise("script").alias("kind"), F.when(is_heading, C.squeeze(C.strip_tags(F.col("x")))).alias("text"))
    order = Window.partitionBy(id_col).orderBy("pos")
    return nearest_heading(events, id_col).select(id_col, F.row_number().over(order).cast("long").alias("ord"), F.length("x").cast("long").alias("n_chars"), "heading")


def convert_diagrams(diagrams: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Convert each distinct content once; what fails keeps its block.

    ``convert`` takes content_sha1, content and gives content_sha1, response (null for a failure).
    """
    keyed = diagrams.withColumn("content_sha1", F.sha1(F.col("content").cast("binary")))
    distinct = keyed.where("language = 'snapdown'").select("content_sha1", "content").dropDuplicates(["content_sha1"])
    answers = convert(distinct).select("content_sha1", scanner(D.answer, "string")(F.col("response")).alias("mermaid"))
    met = keyed.join(answers, "content_sha1", "left")
    done = (F.col("language") == "snapdown") & F.col("mermaid").isNotNull()
    return met.withColumn("content", F.when(done, F.col("mermaid")).otherwise(F.col("content"))).withColumn("language", F.when(done, "mermaid").otherwise(F.col("language"))).drop("mermaid", "content_sha1")


def diagrams_inserted(md: Column, diagrams: Column) -> Column:
    """The Markdown with an array of diagrams in it, each exactly once."""
    return scanner(D.insert, "string")(md, F.coalesce(diagrams, F.array().cast(f"array<{DIAGRAM}>")))


def insert_diagrams(docs: DataFrame, diagrams: DataFrame, id_col: str = "page_id", md_col: str = "md") -> DataFrame:
    """``docs`` with the diagrams of its pages inserted, in order of position."""
    lists = diagrams.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "language", "content", "heading"))).alias("d"))
    met = docs.join(lists, id_col, "left")
    given = F.transform("d", lambda d: F.struct(d["language"].alias("language"), d["content"].alias("content"), d["heading"].alias("heading")))
    return met.withColumn(md_col, diagrams_inserted(F.col(md_col), given)).drop("d")
