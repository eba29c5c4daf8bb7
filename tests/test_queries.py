"""Every Markdown query against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import Row

from quillspark.plans import queries as Q

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(Q.SQL) == set(Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_agrees_with_sql(spark, other_engine, name):
    got = Q.QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    answer = other_engine.execute(Q.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = lambda row: tuple((x is None, str(x)) for x in row)
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()), key=order)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=order) == expected


#: Titles with references that are whole, cut, nested or of other kinds.
TITLES = ("token = &quot", "token = &quot;x&quot;", "a &amp", "a &amp; b", "a &am", "a &", "&amp;quot; &ampquot;", "&lt;b&gt; &#39;c&#39; &nbsp;d", "&quot", "&quot;", "<i>a</i> &quot b", "a\n  b", "", "plain")


def agree(spark, tmp_path, name, table, rows):
    """A query over a made table gives what its SQL does."""
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        answer = con.execute(Q.SQL[name])
        names, expected = [d[0] for d in answer.description], answer.fetchall()
    got = [tuple(r[c] for c in names) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def agree_on_titles(spark, tmp_path, name, titles=TITLES):
    agree(spark, tmp_path, name, "pages", [Row(page_id=k, html=f"<html><head><title>t</title></head><body><h1>{title}</h1><p>x</p></body></html>") for k, title in enumerate(titles * 2, 1)])


def test_headings_with_cut_references(spark, tmp_path):
    agree_on_titles(spark, tmp_path, "diagram_headings")


def test_insertion_under_headings_with_cut_references(spark, tmp_path):
    agree_on_titles(spark, tmp_path, "diagram_insert", tuple(t for t in TITLES if t))  # nothing goes under a heading without a text


#: Paragraphs of more than a chunk that are cut behind a sentence or before a line end, and paragraphs whose indentation is part of the separator.
CUT = ("$$ " + "\n".join(["alpha beta " * 40 + "end."] * 30) + " $$ tail", "$$ " + "\n".join(["alpha beta " * 40] * 30) + " $$ tail", "\n".join([" " + "alpha beta " * 40] * 30))


def test_cut_paragraphs_come_back_whole(spark, tmp_path):
    agree(spark, tmp_path, "pipeline_damaged", "documents", [Row(doc_id=k, text=text) for k, text in enumerate(CUT * 2, 1)])


#: Lines of more than a chunk, cut behind a sentence where the next words look like an item, a quote or a block.
LINES = tuple("alpha beta end. " * 500 + f"{begin}gamma # delta. " * 30 + "alpha beta end. " * 300 for begin in ("- ", "5. ", "> ", "* ", "# ", "## "))


def test_lines_that_are_cut_begin_no_item(spark, tmp_path):
    agree(spark, tmp_path, "pipeline_identity", "documents", [Row(doc_id=k, text=text) for k, text in enumerate(LINES, 1)])
