"""Markdown functions as native columns: no Python on the executors.

Patterns say ``(?U)`` where white space and word characters are Unicode's and
``(?d)`` where only a newline ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.headings import patterns

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
SPACE_ENDS = r"(?U)^\s+|\s+$"
FENCE_LINE = r"^[ \t]*(`{3,}|~{3,})"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """The lines of a text, without their ends; no empty line behind the last end."""
    bare = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(bare, LINE_END, -1))


def excerpt(line: Column, most: int = 120) -> Column:
    compact = strip(line)
    return F.when(F.length(compact) <= most, compact).otherwise(F.concat(F.substring(compact, 1, most - 3), F.lit("...")))


def indent_width(line: Column) -> Column:
    """Columns of a line's indentation; a tab counts four."""
    return F.length(F.replace(F.regexp_extract(line, r"^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


def fence_opener(line: Column) -> Column:
    """The fence characters that open a block, else empty."""
    return F.regexp_extract(line, FENCE_LINE, 1)


def inside_fence(rows: Column) -> Column:
    """For each line whether a fence is open before it: a fold over the lines that may open or close one.

    A fold copies what it holds at every step, so it holds the places of the changes as
    one text; the lines between two changes are alike.
    """
    placed = F.transform(rows, lambda line, k: F.struct(k.alias("at"), line.alias("line")))
    marked = F.filter(placed, lambda m: (F.contains(m["line"], F.lit("```")) | F.contains(m["line"], F.lit("~~~"))) & m["line"].rlike(FENCE_LINE))

    def step(state: Column, mark: Column) -> Column:
        fence, token = state["fence"], fence_opener(mark["line"])
        opens, bare = fence == "", mark["line"].rlike(r"^[ \t]*(`{3,}|~{3,})[ \t]*$")
        ends = bare & (F.substring(token, 1, 1) == F.substring(fence, 1, 1)) & (F.length(token) >= F.length(fence))
        return F.struct(
            F.when(opens, token).when(ends, F.lit("")).otherwise(fence).alias("fence"),
            F.when(opens | ends, F.concat(state["cuts"], F.lit(","), (mark["at"] + 1).cast("string"))).otherwise(state["cuts"]).alias("cuts"), state["n"].alias("n"),
        )

    def finish(state: Column) -> Column:
        cuts = F.transform(F.split(state["cuts"], ","), lambda c: c.cast("int"))
        lengths = F.zip_with(cuts, F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(state["n"])), lambda a, b: b - a)
        return F.flatten(F.transform(lengths, lambda length, k: F.array_repeat(k % 2 == 1, length)))

    start = F.struct(F.lit("").alias("fence"), F.lit("0").alias("cuts"), F.size(rows).alias("n"))
    return F.aggregate(marked, start, step, finish)


def open_fence(rows: Column) -> Column:
    """1-based number and text of the line whose fence is never closed; number 0 if there is none."""

    def step(state: Column, line: Column) -> Column:
        fence = state["fence"]
        shut = F.regexp_extract(line, r"^[ \t]*(`{3,}|~{3,})[ \t]*$", 1)
        ends = (shut != "") & (F.substring(shut, 1, 1) == F.substring(fence, 1, 1)) & (F.length(shut) >= F.length(fence))
        opened, number = fence_opener(line), state["n"] + 1
        starts = (fence == "") & (opened != "")
        return F.struct(
            number.alias("n"), F.when(fence == "", opened).when(ends, F.lit("")).otherwise(fence).alias("fence"),
            F.when(starts, number).when((fence != "") & ends, F.lit(0)).otherwise(state["at"]).alias("at"),
            F.when(starts, line).otherwise(state["line"]).alias("line"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("fence"), F.lit(0).alias("at"), F.lit("").alias("line"))
    return F.aggregate(rows, start, step)


def fence_markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?dm)" + FENCE_LINE))


def dollar_counts(text: Column) -> tuple[Column, Column]:
    """Unescaped single and double dollars."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)\\.|\$\$|\$"), F.lit(0))

    def of(kind: str) -> Column:
        return F.size(F.filter(found, lambda token: token == F.lit(kind)))

    return of("$"), of("$$")


def split_double_fences(text: Column) -> Column:
    """Unindented lines of six fence characters or more become two fences of half as many."""

    def split(line: Column) -> Column:
        half = F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))
        return F.when(line.rlike(r"^(`{6,}|~{6,})$"), F.concat(half, F.lit("\n"), half)).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n", -1), split), "\n")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def heading_collisions(text: Column) -> Column:
    """Headings that stand behind rules, quotes, items or sentences get a line of their own."""
    *lines, sentences = patterns("(?dmU)", "(?U)")
    for pattern in [*lines, sentences.replace("。！？", "")]:  # a class of ASCII alone is a bit set, many times faster
        text = F.regexp_replace(text, pattern, "$1\n$2")
    wide = sentences.replace(r"[.!?。！？\]\)]", "[。！？]")
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("##")) & (F.contains(t, F.lit("。")) | F.contains(t, F.lit("！")) | F.contains(t, F.lit("？"))), F.regexp_replace(t, wide, "$1\n$2")).otherwise(t))[0]


def strip_prompt_markers(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?dmU)^[ \t]*(<<<|>>>)\s*$\n?", "")
    return F.regexp_replace(text, r"(?dmU)^[ \t]*(<<<|>>>)\s*(#+\s*)", "$2")


def escape_cell(text: Column) -> Column:
    """Safe in a table cell."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def fence_for(content: Column) -> Column:
    """Ticks that nothing in the content can close: three, or one more than its longest run."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def url_slug(url: Column, most: int = 120) -> Column:
    """Host, path and query of an address as lower-case words joined by hyphens."""
    bare = F.regexp_replace(strip(url), r"#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    place = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    raw = F.when(query == "", place).otherwise(F.concat_ws("-", place, query))
    read = F.regexp_replace(F.coalesce(F.try_url_decode(raw), raw), "^/+|/+$", "")
    words = F.lower(F.regexp_replace(F.regexp_replace(read, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    short = F.regexp_replace(F.substring(words, 1, most), "-+$", "")
    return F.when(short == "", F.lit("url")).otherwise(short)


def glossary_text(text: Column) -> Column:
    """Folded for matching: lower case (sharp s as ss), hyphens as spaces, single spaces."""
    return squeeze(F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("-"), F.lit(" ")))


def glossary_words(folded: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0)))


def title_line(title: Column) -> Column:
    compact = strip(F.regexp_replace(squeeze(title), "^#+", ""))
    return F.concat(F.lit("# "), F.when(compact == "", F.lit("Document")).otherwise(compact))


def _bullets(label: str, items: Column) -> Column:
    given = F.coalesce(items, F.array().cast("array<string>"))
    listed = F.concat(F.array(F.lit(f"- {label}")), F.transform(given, lambda b: F.concat(F.lit("  - "), b)))
    return F.when(F.size(given) > 0, listed).otherwise(F.array().cast("array<string>"))


def outline_section(outline: Column) -> Column:
    """The outline of an assembled document: headings two levels down, three to six."""

    def entry(e: Column) -> Column:
        head = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(3), e["level"] + 2)).cast("int")), F.lit(" "), e["heading"])
        return F.array_join(F.concat(F.array(head), _bullets("Summary", e["summary_bullets"]), _bullets("Key takeaways", e["key_takeaways"])), "\n")

    body = F.when(F.size(outline) > 0, F.array_join(F.transform(outline, entry), "\n\n")).otherwise("_No outline entries._")
    return F.concat(F.lit("## Outline\n"), body)


def glossary_rows(glossary: Column) -> Column:
    def row(g: Column) -> Column:
        cells = [escape_cell(g[c]) for c in ("term_en", "term_zh", "note_zh")]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells, F.when(g["keep_en_on_first_use"], "true").otherwise("false")), F.lit(" |"))

    return F.array_join(F.transform(glossary, row), "\n")


def _table(names: str, glossary: Column) -> Column:
    rule = "| " + " | ".join(["---"] * 4) + " |"
    return F.when(F.size(glossary) > 0, F.concat(F.lit(f"{names}\n{rule}\n"), glossary_rows(glossary))).otherwise("_No glossary entries._")


def glossary_section(glossary: Column) -> Column:
    return F.concat(F.lit("## Glossary\n"), _table("| Term (EN) | Term (ZH) | Note (ZH) | Keep EN First Use |", glossary))


def glossary_prompt(glossary: Column) -> Column:
    return _table("| term_en | term_zh | note_zh | keep_en_on_first_use |", glossary)


def outline_prompt(outline: Column, mode: str = "headings") -> Column:
    """One line per entry; in full mode with its bullets."""

    def entry(e: Column) -> Column:
        head = F.concat(F.lit("- L"), e["level"].cast("string"), F.lit(" "), e["heading"])
        if mode == "headings":
            return head
        parts = [F.when(F.size(e[f]) > 0, F.concat(F.lit(f"{label}: "), F.array_join(e[f], "; "))) for f, label in (("summary_bullets", "Summary"), ("key_takeaways", "Takeaways"))]
        return F.concat_ws(" | ", head, *parts)

    return F.when(F.size(outline) > 0, F.array_join(F.transform(outline, entry), "\n")).otherwise("_No outline provided._")


def rule_bullets(rules: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(F.filter(rules, lambda r: r != ""), lambda r: F.concat(F.lit("- "), r)), "\n"), F.lit(""))


def meta_section(source_type: Column, source_value: Column, timestamp: Column, model: Column) -> Column:
    return F.concat(F.lit("## Meta\n- Source: "), source_type, F.lit(" "), source_value, F.lit("\n- Timestamp: "), timestamp, F.lit("\n- Model: "), model)


def unwrap_json_fence(text: Column) -> Column:
    """The body of a text that is one fenced block as a whole, else the text; without white space around it."""
    block = r"(?dsU)^\s*```(?:json)?\s*\n(.*?)\n\s*```\s*$"
    return strip(F.when(text.rlike(block), F.regexp_extract(text, block, 1)).otherwise(text))
