"""A Markdown corpus derived from plain documents, by one statement that two SQL dialects read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TICKS, _NL, _BACK = "repeat(chr(96), 3)", "chr(10)", "chr(92)"

#: Eight variants by id: code, lists with fences, glued fences, links, math, residue, unclosed fences, overlong fences.
MD_CORPUS_SQL = f"""
SELECT doc_id,
  '# Doc ' || CAST(doc_id AS STRING) || {_NL} || {_NL} || replace(text, {_NL}, {_NL} || {_NL}) || {_NL} || {_NL}
  || CASE doc_id % 8
     WHEN 0 THEN '## Code' || {_NL} || {_NL} || {_TICKS} || 'python' || {_NL} || 'x = 1  # a' || {_NL} || {_TICKS}
     WHEN 1 THEN '- item ' || chr(96) || 'c' || chr(96) || {_NL} || {_TICKS} || 'text' || {_NL} || 'mis-indented' || {_NL} || {_TICKS}
     WHEN 2 THEN 'glued prose' || {_TICKS} || 'python' || {_NL} || 'y = 2' || {_NL} || {_TICKS}
     WHEN 3 THEN 'See [site](https://example.com/' || CAST(doc_id AS STRING) || ') and [](https://example.com/a)Label' || {_NL} || {_NL} || '[ref]: https://example.com/ref'
     WHEN 4 THEN 'Inline $a_1 + b$ and ' || {_BACK} || '(c' || {_BACK} || ')' || {_NL} || {_NL} || '$$' || {_NL} || 'd = e' || {_NL} || '$$'
     WHEN 5 THEN 'para' || {_NL} || 'check explain' || {_NL} || {_NL} || '1. one' || {_NL} || '- two'
     WHEN 6 THEN repeat('~', 3) || {_NL} || 'never closed'
     ELSE 'requires: p effects: q' || repeat({_NL}, 5) || repeat(chr(96), 6) || {_NL} || '<b>tail</b>'
     END || {_NL} AS md
FROM documents
"""


def md_corpus(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, md for documents with doc_id and text."""
    return spark.sql(MD_CORPUS_SQL.replace("FROM documents", "FROM {documents}"), documents=documents)


_TILDES = "repeat('~', 3)"

#: Six variants of lists and fence marks by id: a block two levels deep, two blocks in a row, ticks in prose, marks in items and prose, an outdented block, a clean one.
LIST_CORPUS_SQL = f"""
SELECT doc_id, 'Doc ' || CAST(doc_id AS STRING) || {_NL} || {_NL} || CASE doc_id % 6
     WHEN 0 THEN '- a' || {_NL} || '    1. b' || {_NL} || '        ' || {_TICKS} || {_NL} || '        x' || {_NL} || '        ' || {_TICKS} || {_NL} || 'after'
     WHEN 1 THEN '- a' || {_NL} || '    ' || {_TICKS} || {_NL} || '    x' || {_NL} || '    ' || {_TICKS} || {_NL} || {_NL} || '    ' || {_TILDES} || {_NL} || '    y' || {_NL} || '    ' || {_TILDES}
     WHEN 2 THEN 'prose with ' || {_TICKS} || ' in it' || {_NL} || 'and glued' || {_TICKS} || 'sql'
     WHEN 3 THEN '- item with ' || {_TICKS} || ' x' || {_NL} || {_NL} || 'text ' || {_TILDES} || ' y'
     WHEN 4 THEN '* a' || {_NL} || '    * b' || {_NL} || {_TICKS} || {_NL} || 'outdented' || {_NL} || {_TICKS} || {_NL} || {_NL} || 'end'
     ELSE '1. a' || {_NL} || {_NL} || '    ' || {_TICKS} || {_NL} || '    fine' || {_NL} || '    ' || {_TICKS} || {_NL} || 'prose' || {_NL} || {_TICKS} || {_NL} || 'no list' || {_NL} || {_TICKS}
     END || {_NL} AS md
FROM documents
"""


def list_corpus(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, md for documents with doc_id."""
    return spark.sql(LIST_CORPUS_SQL.replace("FROM documents", "FROM {documents}"), documents=documents)
