"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering of the whole dialogue in which
its own turns are the assistant's, all others are named users, and the mask marks the
text of its own turns: the characters that a model learns from.  Context roles
(``system``) are rendered as they are for everyone and take no perspective.

A conversation is rendered in parts of ``PART_TURNS`` turns in order, so that one of any
length never has to fit in a single task; usual ones have one part.  Turns are numbered
by one sort over all tasks.  Participants are found first, with map-side combining, and
meet the parts by a join.

Defined cases: a null role is the participant ``unknown``; a null text is empty; turns
without a number come first; ties of a turn number are ordered by role, then text;
repeated rows are rendered repeatedly; marks of the format inside a text or role are
broken by a space, and white space in a role is one space where it is shown; a
conversation of context alone has no perspective, and an empty table no rows; other
columns are ignored.  Masks are
``start:end`` in code points of the part's text, ends exclusive, comma-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import col, numbered

PART_TURNS, CONTEXT, UNKNOWN = 512, ("system",), "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Without marks of the format."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<", "< ", 1)))
    return text


def _head(role: Column, participant: Column, context: tuple[str, ...]) -> Column:
    own = F.concat(F.lit(f"{OPEN}assistant\n"))
    shown = _plain(F.regexp_replace(role, r"\s+", " "))
    given = F.concat(F.lit(OPEN), shown, F.lit("\n"))
    named = F.concat(F.lit(f"{OPEN}user name="), shown, F.lit("\n"))
    return F.when(role == participant, own).when(role.isin(*context), given).otherwise(named)


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context: tuple[str, ...] = CONTEXT, part_turns: int = PART_TURNS) -> DataFrame:
    """A row per conversation, participant and part: conv_id, participant, part, n_turns, n_own, text, mask."""
    given = turns.select(
        col(conv_col).alias("conv_id"), col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit(UNKNOWN)).alias("role"), _plain(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("text")
    )
    part = F.floor((F.col("nth") - 1) / part_turns).cast("long")
    people = given.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    parts = numbered(given, "nth", "turn", "role", "text", within="conv_id").groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    met = parts.join(people, parts.conv_id.eqNullSafe(people.c))
    shown = F.transform("said", lambda t: F.struct(_head(t["role"], F.col("participant"), context).alias("head"), t["text"].alias("text"), (t["role"] == F.col("participant")).alias("own")))
    tail = F.lit(f"{CLOSE}\n")
    step = lambda at, t: F.struct(
        (at["at"] + F.length(t["head"]) + F.length(t["text"]) + F.length(tail)).alias("at"),
        F.when(t["own"], F.concat(at["mask"], F.array(F.concat_ws(":", at["at"] + F.length(t["head"]), at["at"] + F.length(t["head"]) + F.length(t["text"]))))).otherwise(at["mask"]).alias("mask"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask"))
    return met.withColumn("shown", shown).select(
        "conv_id", "participant", "part", F.size("said").cast("long").alias("n_turns"), F.size(F.filter("shown", lambda t: t["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["text"], tail)), "").alias("text"),
        F.array_join(F.aggregate("shown", start, step)["mask"], ",").alias("mask"),
    )
