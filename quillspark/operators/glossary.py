"""Glossary terms of a chunk: relevance, budget, and forms that a translation lost.  No Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import columns as C
from quillspark.functions.arrow import once
from quillspark.operators.lineage import cut

MOST_TERMS, MOST_CHARS = 30, 2000
ENTRY_FIELDS = ("term_en", "term_zh", "note_zh", "keep_en_on_first_use")
ENTRY = "struct<term_en:string,term_zh:string,note_zh:string,keep_en_on_first_use:boolean>"


#: What an index of a glossary may hold to be sent to every task; larger ones are met by a shuffle of tokens.
MOST_SENT = 200_000
#: A token of more than so many chunks is dealt over this many parts where tokens are shuffled.
HOT_CHUNKS, PARTS = 100_000, 64
_PART = "[a-z0-9]"


def _bounded(text: Column) -> Column:
    """A text with a mark at every border of a word, so that a term stands as words where its own marked form stands."""
    return F.regexp_replace(text, r"(?U)\b", "\u0001")


def _seams(text: Column, least: int, most: int) -> Column:
    """What stands between two neighbouring tokens, with so many last characters of one and the first of the other."""
    return F.regexp_extract_all(text, F.lit(f"(?=({_PART}{{{least or 1},{most or 1}}}[^a-z0-9]+{_PART}))"), F.lit(1))


def _signs(text: Column) -> Column:
    """Characters of no token."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[^a-z0-9 ]"), F.lit(0)))


def term_index(terms: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by``, ord, folded, marked, words, several, within, token, seam: each term under tokens of which every chunk that it matters to has one.

    ``terms``: ``by``, ord, term_en.  A phrase of k words matters where half of them occur, so of its words
    the k // 2 + 1 rarest among the terms suffice.  A term also matters where it occurs within longer words.  Then its
    inner tokens occur whole, so the rarest of these is added; a phrase of two tokens is filed under the seam between
    them (up to two characters of one and the first of the other; ``seam`` is how many), and what has neither under a character of no token.
    """
    folded = terms.select(*by, "ord", C.glossary_text(F.col("term_en")).alias("folded")).where("folded <> ''")
    every = F.regexp_extract_all("folded", F.lit(f"{_PART}+"), F.lit(0))
    facts = folded.withColumns({"every": every, "words": F.array_distinct(every), "odd": F.col("folded").rlike(r"(?U)[^\w\s]")})
    facts = facts.withColumn("several", F.size("words") >= 2).withColumn("within", F.col("several") | F.col("odd"))  # within: wherever it occurs, else as words alone
    first = F.when(F.col("within") & F.col("folded").rlike(f"^{_PART}"), 2).otherwise(1)
    last = F.size("every") - F.when(F.col("within") & F.col("folded").rlike(f"{_PART}$"), 1).otherwise(0)
    facts = facts.withColumn("inner", F.array_distinct(F.when(last >= first, F.slice("every", first, last - first + 1)).otherwise(F.array().cast("array<string>"))))
    held = facts.select(*by, "ord", F.explode("words").alias("word"))
    ranked = held.join(held.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n")), [*by, "word"]).groupBy(*by, "ord").agg(F.sort_array(F.collect_list(F.struct("n", (-F.length("word")).alias("short"), "word"))).alias("ranked"))
    met = facts.join(ranked, [*by, "ord"], "left").withColumn("ranked", F.coalesce(F.transform("ranked", lambda r: r["word"]), F.array().cast("array<string>")))
    halves = F.when(F.col("several"), F.slice("ranked", F.lit(1), F.floor(F.size("words") / 2).cast("int") + 1)).otherwise(F.array().cast("array<string>"))
    inside = F.slice(F.filter("ranked", lambda w: F.array_contains(F.col("inner"), w)), 1, 1)
    between = F.regexp_extract("folded", f"({_PART}{{1,2}}[^a-z0-9]+{_PART})", 1)
    is_seam = (F.size("inner") == 0) & (F.size("every") >= 2)
    rest = F.when(F.size("inner") > 0, inside).when(is_seam, F.array(between)).otherwise(F.slice(_signs(F.col("folded")), 1, 1))
    seam = F.when(is_seam, F.least(F.lit(2), F.length(F.try_element_at("every", F.lit(1))))).otherwise(0)
    return met.select(*by, "ord", "folded", _bounded(F.col("folded")).alias("marked"), "words", "several", "within", seam.alias("seam"), F.explode(F.array_distinct(F.concat(halves, rest))).alias("token"))


def _priority(folded: str, marked: str, words: str) -> Column:
    """Of a term and a chunk.  1: a phrase of several words that occurs; 2: another that occurs as words; 3: half of a phrase's words occur."""
    half = 2 * F.size(F.array_intersect("words", words)) >= F.size("words")
    occurs = F.contains(folded, "folded")
    return F.when(F.col("several"), F.when(occurs, 1).when(half, 3)).when(F.col("within"), F.when(occurs, 2)).when(F.contains(marked, "marked"), 2)


def matched_terms(chunks: DataFrame, terms: DataFrame, key: tuple[str, ...], by: tuple[str, ...] = ("doc_id",), text_col: str = "source_text", most_sent: int = MOST_SENT) -> DataFrame:
    """``key``, ord, priority for the terms that matter to a chunk, each once.

    ``chunks``: ``key``, ``by`` and a text.  ``terms``: ``by``, ord, term_en.  Distinct tokens of chunks meet the tokens
    under which terms are filed by an equality join, and what they meet is verified.  An
    index of at most ``most_sent`` rows, which are counted, is broadcast; beyond that tokens are shuffled with their chunk's key alone,
    those of very many chunks dealt over parts, and texts meet the candidates again by key.
    """
    index = cut(term_index(terms, by))
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("seam") > 0, F.col("seam"))).alias("least"), F.max("seam").alias("most"), F.max(~F.col("token").rlike(_PART)).alias("signs"), F.max(~F.col("several") & ~F.col("within")).alias("alone")).first()
    kept = list(dict.fromkeys([*key, *by]))
    folded = chunks.select(*kept, once(F.coalesce(C.glossary_text(F.col(text_col)), F.lit(""))).alias("__folded"))
    worded = folded.select(*kept, "__folded", once(F.array_distinct(F.regexp_extract_all("__folded", F.lit(f"{_PART}+"), F.lit(0)))).alias("__words"))
    found = [(True, F.col("__words")), (facts["signs"], _signs(F.col("__folded"))), (facts["most"], F.array_distinct(_seams(F.col("__folded"), facts["least"], facts["most"])))]
    every = F.concat(*(c for needed, c in found if needed))  # only kinds of tokens under which a term is filed
    marked, on = worded.select("*", once(_bounded(F.col("__folded")) if facts["alone"] else F.lit("")).alias("__marked")), [*by, "token"]
    if facts["n"] <= most_sent:
        tokens = marked.select("*", once(every).alias("__every")).select(*marked.columns, F.explode("__every").alias("token"))
        found = tokens.join(F.broadcast(index), on).select(*key, "ord", once(_priority("__folded", "__marked", "__words")).alias("priority")).where("priority IS NOT NULL")
        return found.groupBy(*key, "ord").agg(F.min("priority").alias("priority"))
    asked = cut(worded.select(*kept, once(every).alias("__every")).select(*kept, F.explode("__every").alias("token")).join(index.select(*on).distinct(), on, "left_semi"))
    hot = asked.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_CHUNKS).select(*on, F.lit(PARTS).alias("parts"))  # one in HOT_CHUNKS rows at most
    of = lambda df, part: df.join(hot, on, "left").withColumn("part", part)
    dealt = of(asked, F.pmod(F.xxhash64(*key), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copied = of(index.select(*on, "ord"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    pairs = dealt.join(copied, [*on, "part"]).select(*kept, "ord").distinct()
    facts = index.select(*by, "ord", "folded", "marked", "words", "several", "within").dropDuplicates([*by, "ord"])
    texts = marked.join(pairs, kept).join(facts, [*by, "ord"])
    return texts.select(*key, "ord", _priority("__folded", "__marked", "__words").alias("priority")).where("priority IS NOT NULL")


def within_budget(ranked: Column, most_terms: int = MOST_TERMS, most_chars: int = MOST_CHARS) -> Column:
    """Take entries in order while there is room: what has too many characters is skipped, the number ends it."""

    def step(state: Column, e: Column) -> Column:
        chars = F.length(e["entry"]["term_en"]) + F.length(e["entry"]["term_zh"]) + F.length(e["entry"]["note_zh"])
        fits = (F.size(state["kept"]) < most_terms) & (state["chars"] + chars <= most_chars)
        return F.struct(
            F.when(fits, state["chars"] + chars).otherwise(state["chars"]).alias("chars"), F.when(fits, F.concat(state["kept"], F.array(e["entry"]))).otherwise(state["kept"]).alias("kept")
        )

    start = F.struct(F.lit(0).alias("chars"), F.array().cast(f"array<{ENTRY}>").alias("kept"))
    return F.aggregate(ranked, start, step)["kept"]


def ranked_terms(chunks: DataFrame, terms: DataFrame, key: tuple[str, ...], by: tuple[str, ...] = ("doc_id",), text_col: str = "source_text", **how) -> DataFrame:
    """``key`` and ranked, array<struct<priority, ord, entry>> of the terms that matter, best first; no row for chunks without any.

    ``terms``: ``by``, ord and the fields of an entry.
    """
    matched = matched_terms(chunks, terms, key, by, text_col, **how)
    given = chunks.select(*dict.fromkeys([*key, *by])).join(matched, list(key)) if set(by) - set(key) else matched
    entry = F.struct(*(F.col(c) for c in ENTRY_FIELDS)).alias("entry")
    met = given.join(terms.select(*by, "ord", entry), [*by, "ord"])
    return met.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("priority", "ord", "entry"))).alias("ranked"))


def filter_glossary(chunks: DataFrame, terms: DataFrame, key: tuple[str, ...], by: tuple[str, ...] = ("doc_id",), text_col: str = "source_text", most_terms: int = MOST_TERMS, most_chars: int = MOST_CHARS, **how) -> DataFrame:
    """``chunks`` with a column terms: the entries of the glossary that fit the chunk and the budget, an array without any where none does."""
    empty = F.array().cast(f"array<{ENTRY}>")
    if most_terms <= 0 or most_chars <= 0 or terms.isEmpty():
        return chunks.withColumn("terms", empty)
    kept = ranked_terms(chunks, terms, key, by, text_col, **how).select(*key, within_budget(F.col("ranked"), most_terms, most_chars).alias("terms"))
    return chunks.join(kept, list(key), "left").withColumn("terms", F.coalesce("terms", empty))


def as_terms(docs: DataFrame, by: str = "doc_id", glossary_col: str = "glossary") -> DataFrame:
    """``by``, ord (from 0) and the fields of each entry of a column of glossaries."""
    rows = docs.select(by, F.posexplode(glossary_col).alias("ord", "g"))
    return rows.select(by, "ord", *(F.col(f"g.{c}").alias(c) for c in ENTRY_FIELDS))


def lost_forms(text: Column, glossary: Column) -> Column:
    """A warning for each entry whose English form stands in the text while its Chinese form doesn't."""
    lost = F.filter(glossary, lambda g: F.contains(text, g["term_en"]) & ~F.contains(text, g["term_zh"]))
    return F.transform(lost, lambda g: F.concat(F.lit("glossary term '"), g["term_en"], F.lit("' missing Chinese form '"), g["term_zh"], F.lit("'")))
