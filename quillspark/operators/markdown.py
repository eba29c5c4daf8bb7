"""Line, lint and repair operators over a table of Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import columns as C
from quillspark.functions.arrow import once, scanner
from quillspark.functions.autofix import autofix, guard, indent_list_blocks
from quillspark.functions.lint import BROKEN_LINK, CLEAN_REPORT, lint
from quillspark.functions.sanitize import RESIDUE, clean_fetched, clean_links, collapse_blanks, drop_residue, sanitize, split_requires
from quillspark.functions.scan import by_line, rewrite_outside

#: Rules that one pattern over a line outside fences states.
LINE_RULES = {"BROKEN_LINK_EMPTY_LABEL": BROKEN_LINK.pattern, "INTERACTIVE_RESIDUE": f"(?i){RESIDUE.pattern}"}
ISSUES = "array<struct<rule_id:string,line:bigint,message:string,excerpt:string>>"


def issues_of(md: Column, strict: bool = True, max_depth: int = 1) -> Column:
    """The lint issues of a document, in order."""
    return scanner(lambda t: [i._asdict() for i in lint(t, strict, max_depth)], ISSUES)(md)


def sanitized(md: Column, aggressive: bool = True) -> Column:
    return scanner(lambda t: sanitize(t, aggressive), "string")(md)


def fetched_cleaned(md: Column) -> Column:
    """Sanitized, and cleaned of what a reader service leaves behind."""
    return scanner(lambda t: clean_fetched(sanitize(t)), "string")(md)


def repaired(md: Column, strict: bool = True, max_depth: int = 1) -> Column:
    return scanner(lambda t: autofix(t, strict, max_depth), "string")(md)


def list_blocks_indented(md: Column) -> Column:
    return scanner(indent_list_blocks, "string")(md)


def links_cleaned(md: Column) -> Column:
    """Only the link pass, outside fences."""
    return scanner(by_line(lambda x: rewrite_outside(x, lambda line: [clean_links(line)])), "string")(md)


def residue_dropped(md: Column) -> Column:
    return scanner(by_line(drop_residue), "string")(md)


def blanks_collapsed(md: Column) -> Column:
    return scanner(by_line(collapse_blanks), "string")(md)


def requires_split(md: Column) -> Column:
    return scanner(by_line(lambda x: rewrite_outside(x, split_requires)), "string")(md)


def guarded(md: Column, strict: bool = True, max_depth: int = 1) -> Column:
    """struct<value, issues, error>: repaired text, what lint still finds, and the report if it finds anything."""

    def run(text: str) -> dict:
        value, issues, error = guard(text, strict, max_depth)
        return {"value": value, "issues": [i._asdict() for i in issues], "error": error}

    return scanner(run, f"struct<value:string,issues:{ISSUES},error:string>")(md)


def _rows(docs: DataFrame, id_col: str, md_col: str) -> DataFrame:
    """id and rows, the array of a document's lines."""
    return docs.select(F.col(id_col), once(C.lines(F.col(md_col))).alias("rows"))


def md_lines(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, line_no (from 1), line."""
    rows = docs.select(F.col(id_col), F.posexplode(C.lines(F.col(md_col))).alias("at", "line"))
    return rows.select(id_col, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def fence_mask(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, line_no, in_fence: whether a block is open before the line; one fold over each document's lines."""
    state = F.posexplode(C.inside_fence(F.col("rows"))).alias("at", "in_fence")
    return _rows(docs, id_col, md_col).select(F.col(id_col), state).select(id_col, (F.col("at") + 1).cast("long").alias("line_no"), "in_fence")


def fenced_lines(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, line_no, line, in_fence: lines and the state before each from one explosion."""
    rows = F.col("rows")
    both = F.posexplode(F.arrays_zip(rows.alias("line"), C.inside_fence(rows).alias("in_fence"))).alias("at", "x")
    return _rows(docs, id_col, md_col).select(F.col(id_col), both).select(id_col, (F.col("at") + 1).cast("long").alias("line_no"), F.col("x.line").alias("line"), F.col("x.in_fence").alias("in_fence"))


def outside_lines(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, line_no, line of the lines outside fenced blocks, openers included."""
    return fenced_lines(docs, id_col, md_col).where("NOT in_fence").drop("in_fence")


def lines_breaking(docs: DataFrame, rule: str, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, rule_id, line, excerpt of a rule that one pattern states; no Python."""
    found = outside_lines(docs, id_col, md_col).where(F.col("line").rlike("(?U)" + LINE_RULES[rule]))
    return found.select(id_col, F.lit(rule).alias("rule_id"), F.col("line_no").alias("line"), C.excerpt(F.col("line")).alias("excerpt"))


def unclosed_fences(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, line, excerpt of fences that stay open; no Python."""
    found = docs.select(F.col(id_col), C.open_fence(C.lines(F.col(md_col))).alias("f")).where("f.fence <> ''")
    return found.select(id_col, F.col("f.at").cast("long").alias("line"), C.excerpt(F.col("f.line")).alias("excerpt"))


def lint_issues(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md", strict: bool = True, max_depth: int = 1) -> DataFrame:
    """doc_id, ord (from 1), rule_id, line, message, excerpt."""
    rows = docs.select(F.col(id_col), once(issues_of(F.col(md_col), strict, max_depth)).alias("issues")).select(id_col, F.posexplode("issues").alias("at", "i"))
    return rows.select(id_col, (F.col("at") + 1).cast("long").alias("ord"), "i.rule_id", "i.line", "i.message", "i.excerpt")


def lint_report(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md", strict: bool = True, max_depth: int = 1) -> DataFrame:
    """doc_id, n_issues, report: a line for each issue."""
    issues = docs.select(F.col(id_col), once(issues_of(F.col(md_col), strict, max_depth)).alias("issues"))
    shown = F.transform("issues", lambda i: F.concat(i["rule_id"], F.lit(" line "), i["line"].cast("string"), F.lit(": "), i["message"], F.lit(" | "), i["excerpt"]))
    return issues.select(id_col, F.size("issues").cast("long").alias("n_issues"), F.when(F.size("issues") == 0, CLEAN_REPORT).otherwise(F.array_join(shown, "\n")).alias("report"))
