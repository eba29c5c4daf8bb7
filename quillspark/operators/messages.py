"""Chat messages as columns: array<struct<role, content>>.  No Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import columns as C, prompts as P


def chat(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def _part(title: str, body: Column) -> Column:
    """A titled part with a blank line before it; nothing for an empty body."""
    return F.when(body != "", F.concat(F.lit(f"\n\n{title}\n"), body)).otherwise("")


def translate_messages(protected: Column, outline: Column, glossary: Column, rules: Column, placeholders: Column, outline_mode: str = "headings", source_language: str = "en", target_language: str = "zh-CN") -> Column:
    names = F.array_join(F.transform(placeholders, lambda p: F.concat(F.lit("- "), p)), "\n")
    user = F.concat(
        F.lit(P.translate_rules(source_language, target_language)), _part("For this document:", C.rule_bullets(rules)), _part("Tokens of this part:", names),
        F.lit("\n\nOutline of the document:\n"), C.outline_prompt(outline, outline_mode), F.lit("\n\nGlossary:\n"), C.glossary_prompt(glossary),
        F.lit("\n\nThe part, between the marks:\n<<<\n"), protected, F.lit("\n>>>"),
    )
    return chat(P.TRANSLATE_SYSTEM, user)


def profile_messages(content: Column, source_type: Column, source_value: Column, title_hint: Column, source_language: str = "en", target_language: str = "zh-CN") -> Column:
    hint = F.when(F.coalesce(title_hint, F.lit("")) != "", F.concat(F.lit("\n- title_hint: "), title_hint)).otherwise("")
    user = F.concat(
        F.lit(f"Describe the document between the marks, in the shape of this example:\n{P.PROFILE_EXAMPLE}\nWhat holds for its fields:\n{P.profile_rules(target_language)}\n\nWhat is known of it:\n- source_type: "),
        source_type, F.lit("\n- source_value: "), source_value, F.lit(f"\n- source_language: {source_language}\n- target_language: {target_language}"), hint,
        F.lit("\n\n<<<\n"), content, F.lit("\n>>>"),
    )
    return chat(P.PROFILE_SYSTEM, user)


def diagram_messages(content: Column) -> Column:
    return chat(P.DIAGRAM_SYSTEM, F.concat(F.lit("The diagram:\n"), content))


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """conv_id, n_messages, prompt: the turns of each conversation in order, one line of role and text each."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    shown = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return rows.select("conv_id", F.size("m").cast("long").alias("n_messages"), shown.alias("prompt"))
