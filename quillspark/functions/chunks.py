"""Chunk plans: sections at headings, paragraphs at blank lines, greedy packing, exact reassembly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from quillspark.functions.scan import Spans
from quillspark.functions.spans import find_spans

HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+")
BLANK = re.compile(r"\n[ \t]*(?:\r?\n[ \t]*)+")  # without the \r that may stand before it
SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")
DEFAULT_CHARS = 8000


class Chunk(NamedTuple):
    chunk_id: str
    source_text: str
    separators: list[str]


class PlanError(ValueError):
    """A plan that can't be made; carries the message of the error column."""


def section_starts(text: str, spans: Spans) -> list[int]:
    """Where sections begin: the start, and every heading line outside spans."""
    out, at = [0], 0
    for line in text.splitlines(keepends=True):
        if at and "#" in line and HEADING.match(line) and not spans.holds(at):
            out.append(at)
        at += len(line)
    return out


def paragraphs(text: str, start: int, end: int, spans: Spans) -> Iterator[tuple[str, str]]:
    """Text and separator of the paragraphs of a section; blank lines inside a span don't separate."""
    section, last = text[start:end], 0
    for m in BLANK.finditer(section):
        at, behind = m.span()
        at -= section[at - 1 : at] == "\r"
        if not spans.overlaps(start + at, start + behind):
            yield section[last:at], section[at:behind]
            last = behind
    yield section[last:], ""


def cut_at(text: str, most: int) -> int:
    """Where a text that is too long is best cut: behind a sentence, before a line end, before a space, or at the limit."""
    ends = [m.end() for m in SENTENCE_END.finditer(text, 0, most)]
    options = (ends[-1] if ends else 0, text.rfind("\n", 0, most), text.rfind(" ", 0, most))
    return next((k for k in options if k > 0), most)


def pieces(text: str, separator: str, most: int) -> Iterator[tuple[str, str]]:
    """A paragraph in parts of at most ``most`` characters; its separator stands alone if it has no room."""
    while len(text) > most:
        k = cut_at(text, most)
        yield text[:k], ""
        text = text[k:]
    if len(separator) > most:
        raise PlanError("separator exceeds max-chunk-chars")
    if len(text) + len(separator) <= most:
        if text or separator:
            yield text, separator
    else:
        yield text, ""
        yield "", separator


def pack(parts: Iterator[tuple[str, str]], most: int) -> Iterator[tuple[str, list[str]]]:
    """Fill chunks in order, each until the next part has no room."""
    held: list[tuple[str, str]] = []
    size = 0
    for text, separator in parts:
        n = len(text) + len(separator)
        if held and size and size + n > most:
            yield "".join(map("".join, held)), [s for _, s in held]
            held, size = [], 0
        held.append((text, separator))
        size += n
    if held:
        yield "".join(map("".join, held)), [s for _, s in held]


def sections(text: str, most: int) -> Iterator[Iterator[tuple[str, str]]]:
    """The pieces of each section of a text, in order."""
    spans = Spans()
    for start, end, kind in find_spans(text):
        spans.add(start, end, kind)
    starts = section_starts(text, spans)
    for start, end in zip(starts, [*starts[1:], len(text)], strict=True):
        yield (p for part in paragraphs(text, start, end, spans) for p in pieces(*part, most))


def units(text: str, most: int = DEFAULT_CHARS) -> list[tuple[int, int, int]]:
    """Section (from 0), number in it (from 1) and characters of each piece; what chunks are packed of."""
    return [(s, k, sum(map(len, piece))) for s, parts in enumerate(sections(text, most) if text else ()) for k, piece in enumerate(parts, 1)]


def plan(text: str, most: int = DEFAULT_CHARS) -> list[Chunk]:
    """The chunks of a text: no heading within, none longer than ``most``, together the text itself."""
    if most <= 0:
        raise PlanError("max-chunk-chars must be positive")
    if not text:
        return []
    drafts = [draft for parts in sections(text, most) for draft in pack(parts, most)]
    digits = max(4, len(str(len(drafts))))
    return [Chunk(f"chunk-{k:0{digits}d}", source, separators) for k, (source, separators) in enumerate(drafts, 1)]


def rebuild(chunks: list[Chunk]) -> str:
    return "".join(c.source_text for c in chunks)
