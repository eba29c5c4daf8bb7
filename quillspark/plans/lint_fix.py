"""Lint a corpus, or fix it and keep what came out clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators import markdown as M


def lint_counts(docs: DataFrame, md_col: str = "md", strict: bool = True, max_depth: int = 1) -> DataFrame:
    """rule_id, n_issues, n_docs."""
    issues = M.lint_issues(docs, md_col=md_col, strict=strict, max_depth=max_depth)
    per_doc = issues.groupBy("rule_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("rule_id").agg(F.sum("n").alias("n_issues"), F.count(F.lit(1)).alias("n_docs"))


def fix(docs: DataFrame, md_col: str = "md", strict: bool = True, max_depth: int = 1) -> DataFrame:
    """``docs`` with fixed and issues: sanitized, repaired, linted; write the rows without issues."""
    fixed = docs.withColumn("fixed", M.repaired(M.sanitized(F.col(md_col)), strict, max_depth))
    return fixed.withColumn("issues", M.issues_of(F.col("fixed"), strict, max_depth))
