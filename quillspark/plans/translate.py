"""The whole way of a document: clean, profile, plan, protect, translate, restore, assemble, guard."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import answers as A, columns as C
from quillspark.functions.arrow import checked, once
from quillspark.functions.spans import SpanError
from quillspark.operators import assemble, chunking, glossary as G, markdown as M, messages as P, preserve
from quillspark.operators.answers import answered
from quillspark.operators.lineage import shared_folder
from quillspark.operators.model import Client, Retry
from quillspark.operators.profile import document_title, parsed
from quillspark.plans.stages import Stages

FINISHED = "struct<text:string,warnings:array<string>>"


@dataclass(frozen=True)
class Options:
    """What a run depends on; nothing is read from the environment."""

    chunk_chars: int = 8000
    concurrency: int = 3
    outline_mode: str = "headings"
    glossary_mode: str = "filtered"
    strict: bool = True
    max_depth: int = 1
    most_terms: int = G.MOST_TERMS
    most_chars: int = G.MOST_CHARS
    model: str = "unknown"
    timestamp: str = "1970-01-01T00:00:00Z"
    retry: Retry = Retry()
    waves: int = 1

    @classmethod
    def from_env(cls, env: Mapping[str, str], **given) -> Options:
        """Options from QUILLSPARK_STRICT, _MAX_LIST_DEPTH, _GLOSSARY_TERMS, _GLOSSARY_CHARS; what isn't valid is left at its default.

        Read on the driver alone: executors get the values.
        """
        words = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        found: dict = {}
        if (strict := words.get(env.get("QUILLSPARK_STRICT", "").strip().lower())) is not None:
            found["strict"] = strict
        for name, field, least in (("MAX_LIST_DEPTH", "max_depth", 1), ("GLOSSARY_TERMS", "most_terms", 0), ("GLOSSARY_CHARS", "most_chars", 0)):
            raw = env.get(f"QUILLSPARK_{name}", "").strip()
            if re.fullmatch(r"[+-]?\d+", raw):
                value = int(raw)
                if value >= least or field == "max_depth":
                    found[field] = max(least, value)
        return cls(**found | given)


def finished(answer, original, entries, before, options: Options):
    """struct<value<text, warnings>, error> of a model's answer; ``before``: the last sign of the chunk before."""

    def run(text: str, source: str, kept: list[dict], sign: str) -> dict:
        out, warnings = A.finish(text, source, {e["placeholder"]: e["original"] for e in kept}, options.strict, options.max_depth, sign)
        return {"text": out, "warnings": warnings}

    return checked(run, FINISHED, SpanError)(answer, original, entries, before)


def ask_profiles(docs: DataFrame, make_client: Callable[[], Client], options: Options, path: str) -> DataFrame:
    """doc_id, response, error, calls: one question a document; ``path``: the table of answers."""
    asked = docs.select("doc_id", P.profile_messages(F.col("md"), F.col("source_type"), F.col("source_value"), F.col("title_hint")).alias("messages"))
    return answered(asked, make_client, ("doc_id",), path, options.model, True, options.concurrency, options.retry, options.waves)


def read_profiles(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, profile (with its markdown), error of documents and what a model said of them."""
    met = docs.select("doc_id", "source_type", "source_value", "title_hint").join(replies, "doc_id")
    response, hint = C.unwrap_json_fence(F.col("response")), F.col("title_hint")
    rows = met.select("doc_id", F.col("error").alias("call_error"), once(parsed(response, F.col("source_type"), F.col("source_value"), hint)).alias("p"))
    return rows.select("doc_id", F.col("p.value").alias("profile"), F.coalesce("call_error", "p.error").alias("error"))


def profile(docs: DataFrame, make_client: Callable[[], Client], options: Options = Options(), folder: str | None = None) -> DataFrame:
    """doc_id, profile (with its markdown), error: only this step of a translation."""
    answers = f"{folder or shared_folder(docs.sparkSession)}/answers"
    return read_profiles(docs, ask_profiles(docs, make_client, options, answers))


def translate(docs: DataFrame, make_client: Callable[[], Client], options: Options = Options(), folder: str | None = None) -> dict[str, DataFrame]:
    """Tables documents (doc_id, text, issues, error) and chunks (doc_id, idx, text, warnings, calls, error).

    ``docs``: doc_id, source_type, source_value, title_hint, md.  Every stage is a table under ``folder``, and so are the
    model's answers: a second call with the same folder repeats no stage that was finished and no call that
    was answered.  ``folder`` is one that driver and executors share; by default a new one in the checkpoint folder.
    """
    if options.glossary_mode not in ("filtered", "full"):
        raise ValueError("glossary_mode must be 'filtered' or 'full'")
    stages = Stages(docs.sparkSession, folder)
    answers = f"{stages.folder}/answers"

    def protect_chunks(plan: DataFrame, known: DataFrame) -> DataFrame:
        """Chunks of documents with a profile: their terms, their protected text, the messages about them."""
        rows = plan.where("error IS NULL").join(known.where("error IS NULL").select("doc_id", F.col("profile.outline").alias("outline"), F.col("profile.glossary").alias("glossary"), F.col("profile.style_guide.rules").alias("rules")), "doc_id")
        if options.glossary_mode == "full":
            given = rows.withColumn("terms", F.col("glossary"))
        else:
            given = G.filter_glossary(rows, G.as_terms(known.where("error IS NULL").select("doc_id", F.col("profile.glossary").alias("glossary"))), ("doc_id", "idx"), most_terms=options.most_terms, most_chars=options.most_chars)
        safe = given.select("*", once(preserve.protected(F.col("source_text"))).alias("p")).withColumn("map", F.col("p.value.map"))
        names = F.array_sort(F.transform("map", lambda e: e["placeholder"]))
        messages = P.translate_messages(F.col("p.value.text"), F.col("outline"), F.col("terms"), F.col("rules"), names, options.outline_mode)
        return safe.select("doc_id", "idx", "chunk_id", "source_text", "separators", "terms", "map", F.col("p.error").alias("protect_error"), names.alias("placeholders"), messages.alias("messages"))

    def ask_chunks(safe: DataFrame) -> DataFrame:
        return answered(safe.where("protect_error IS NULL").select("doc_id", "idx", "placeholders", "messages"), make_client, ("doc_id", "idx"), answers, options.model, False, options.concurrency, options.retry, options.waves)

    def restore_chunks(safe: DataFrame, said: DataFrame) -> DataFrame:
        cut = safe.where(~F.endswith("source_text", F.lit("\n"))).select("doc_id", (F.col("idx") + 1).alias("idx"), F.right("source_text", F.lit(1)).alias("before"))  # the next chunk goes on in the line
        met = safe.join(said, ["doc_id", "idx"], "left").join(cut, ["doc_id", "idx"], "left")
        done = met.select("*", once(finished(F.col("response"), F.col("source_text"), F.col("map"), F.coalesce("before", F.lit("")), options)).alias("f"))
        return done.select(
            "doc_id", "idx", "chunk_id", "separators", F.col("f.value.text").alias("text"), F.concat(F.col("f.value.warnings"), G.lost_forms(F.col("f.value.text"), F.col("terms"))).alias("warnings"), "calls",
            F.coalesce("protect_error", "error", F.concat(F.lit("restore failed: "), F.col("f.error"))).alias("error"),
        )

    def assemble_documents(clean: DataFrame, known: DataFrame, plan: DataFrame, chunks: DataFrame) -> DataFrame:
        bodies = assemble.merge_translations(chunks, chunks)
        failed = chunks.where("error IS NOT NULL").groupBy("doc_id").agg(F.min_by("error", "idx").alias("chunk_error"))
        unplanned = plan.where("error IS NOT NULL").select("doc_id", F.col("error").alias("plan_error"))
        every = clean.drop("md").join(known, "doc_id", "left").join(bodies, "doc_id", "left").join(failed, "doc_id", "left").join(unplanned, "doc_id", "left")
        title = document_title(F.col("profile.doc.title"), F.col("title_hint"), F.col("source_value"))
        meta = C.meta_section(F.col("source_type"), F.col("source_value"), F.lit(options.timestamp), F.lit(options.model))
        text = assemble.assembled(title, meta, F.col("profile.outline"), F.col("profile.glossary"), F.coalesce("body", F.lit("")))
        broken = F.coalesce("error", "plan_error", "chunk_error")
        guarded = every.select("doc_id", broken.alias("broken"), once(M.guarded(F.when(broken.isNull(), text), options.strict, options.max_depth)).alias("g"))
        return guarded.select("doc_id", F.col("g.value").alias("text"), F.col("g.issues").alias("issues"), F.coalesce("broken", "g.error").alias("error"))

    clean = stages.first("clean", docs, lambda rows: rows.withColumn("md", M.fetched_cleaned(F.col("md"))))
    replies = stages.then("profile-answers", [clean], lambda rows: ask_profiles(rows, make_client, options, answers), options.model)
    known = stages.then("profiles", [clean, replies], read_profiles)
    plan = stages.then("plan", [clean], lambda rows: chunking.chunk_plan(rows, most=options.chunk_chars), options.chunk_chars)
    safe = stages.then("protected", [plan, known], protect_chunks, options.glossary_mode, options.outline_mode, options.most_terms, options.most_chars)
    said = stages.then("chunk-answers", [safe], ask_chunks, options.model)
    chunks = stages.then("chunks", [safe, said], restore_chunks, options.strict, options.max_depth)
    done = stages.then("documents", [clean, known, plan, chunks], assemble_documents, options.strict, options.max_depth, options.timestamp, options.model)
    return {"documents": done.table, "chunks": chunks.table}
