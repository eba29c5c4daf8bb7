"""SQL names for the Markdown functions: SELECT md_lint(md) FROM docs, and SELECT d.*, i.* FROM docs d, LATERAL md_issues(d.md) i."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession, functions as F

from quillspark.functions import chunks as K, spans as S
from quillspark.functions.arrow import arrow_function
from quillspark.functions.autofix import autofix, indent_list_blocks
from quillspark.functions.lint import lint
from quillspark.functions.sanitize import sanitize

ISSUES = "array<struct<rule_id:string,line:bigint,message:string,excerpt:string>>"
FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "md_sanitize": (sanitize, "string"),
    "md_autofix": (autofix, "string"),
    "md_indent_list_blocks": (indent_list_blocks, "string"),
    "md_lint": (lambda t: [i._asdict() for i in lint(t)], ISSUES),
    "md_spans": (lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in S.find_spans(t)], "array<struct<start:bigint,end:bigint,kind:string>>"),
    "md_url_targets": (S.url_targets, "array<string>"),
    "md_chunks": (lambda t: [c._asdict() for c in K.plan(t)], "array<struct<chunk_id:string,source_text:string,separators:array<string>>>"),
}


class Issues:
    """Rows of lint issues: a text's rows stream out, and nothing holds them as an array."""

    def eval(self, md: str) -> Iterator[tuple]:
        for k, issue in enumerate(lint(md) if md is not None else (), 1):
            yield k, *issue


class Spans:
    """Rows of protected spans."""

    def eval(self, md: str) -> Iterator[tuple]:
        yield from S.find_spans(md) if md is not None else ()


TABLES: dict[str, tuple[type, str]] = {
    "md_issues": (Issues, "ord long, rule_id string, line long, message string, excerpt string"),
    "md_span_rows": (Spans, "start long, end long, kind string"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions with a session; null gives null, and no rows."""
    for name, (function, returns) in FUNCTIONS.items():
        spark.udf.register(name, arrow_function(function, returns))
    for name, (function, returns) in TABLES.items():
        spark.udtf.register(name, F.udtf(function, returnType=returns, useArrow=True))
    return [*FUNCTIONS, *TABLES]
