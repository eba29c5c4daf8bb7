"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.lineage import cut, drop_folder, numbered, shared_folder

__all__ = ["ascii_lower", "col", "cut", "drop_folder", "free_name", "held_out", "id_type", "numbered", "same_key", "shared_folder"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_key(*columns: Column) -> Column:
    """One string that is equal exactly where all columns are, nulls included: a join and a window on it share their exchange."""
    return F.concat(*(F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that fitting never sees (crc32 of the id's text, remainder 2)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
