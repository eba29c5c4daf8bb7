"""Embedded diagrams: scripts and headings in HTML, answers of a converter, insertion under headings."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable

# Element patterns.
SCRIPT = re.compile(r"<script\b[^>]*\btype\s*=\s*['\"]application/snapdown(\+json)?['\"][^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)
HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1>", re.IGNORECASE | re.DOTALL)
TAG = re.compile(r"<[^>]+>")
SECTION = "## Snapdown Diagrams (extracted)"


def squeeze(text: str) -> str:
    return " ".join(text.split())


def decoded(text: str, references: Iterable[tuple[str, str]] | None = None) -> str:
    """A text with signs for its character references: all that HTML has, or these patterns alone, one after the other."""
    if references is None:
        return html.unescape(text)
    for pattern, sign in references:
        text = re.sub(pattern, sign, text)
    return text


def page_events(page: str, references: Iterable[tuple[str, str]] | None = None) -> list[dict]:
    """Headings and diagram scripts of a page: position, kind, text; empty ones and JSON scripts left out.  ``references``: those of headings, as in ``decoded``."""
    found = [{"pos": m.start(), "kind": "heading", "text": squeeze(decoded(TAG.sub("", m[2]), references))} for m in HEADING.finditer(page)]
    found += [{"pos": m.start(), "kind": "diagram", "text": html.unescape(m[2]).strip()} for m in SCRIPT.finditer(page) if not m[1]]
    return sorted((e for e in found if e["text"]), key=lambda e: (e["pos"], e["kind"] != "diagram"))


def extract(page: str) -> list[dict]:
    """The diagrams of a page, each with the nearest heading before it."""
    out, heading = [], None
    for e in page_events(page):
        if e["kind"] == "heading":
            heading = e["text"]
        else:
            out.append({"pos": e["pos"], "language": "snapdown", "content": e["text"], "heading": heading})
    return out


def fence_for(content: str) -> str:
    return "`" * max(3, 1 + max(map(len, re.findall("`+", content)), default=0))


def block(diagram: dict) -> list[str]:
    fence = fence_for(diagram["content"])
    return [fence + diagram["language"], diagram["content"], fence]


def append(markdown: str, diagrams: list[dict]) -> str:
    """A section at the end with all diagrams."""
    if not diagrams:
        return markdown
    body = "\n\n".join("\n".join(block(d)) for d in diagrams)
    return markdown.rstrip("\n") + f"\n\n{SECTION}\n\n{body}\n"


def insert(markdown: str, diagrams: list[dict]) -> str:
    """Every diagram exactly once: under the next heading that names it, in order, or in a section at the end."""
    if not diagrams:
        return markdown
    lines, after, left = markdown.splitlines(), {}, []
    titles = [squeeze(x.lstrip().lstrip("# ")) if x.lstrip().startswith("#") else None for x in lines]
    cursor = 0
    for d in diagrams:
        wanted = squeeze(d.get("heading") or "")
        at = next((k for k in range(cursor, len(lines)) if wanted and titles[k] == wanted), None)
        if at is None:
            left.append(d)
            continue
        place = next((k for k in range(at + 1, len(lines)) if lines[k].strip()), len(lines))
        after.setdefault(place, []).extend([*block(d), ""])
        cursor = max(place, at + 1)
    merged = [x for k in range(len(lines) + 1) for x in [*after.get(k, []), *lines[k : k + 1]]]
    text = "\n".join(merged)
    if markdown.endswith("\n") and not text.endswith("\n"):
        text += "\n"
    return append(text, left)


def answer(response: str | None) -> str | None:
    """The diagram in a converter's answer: its JSON value, or the answer itself if it isn't JSON."""
    text = (response or "").strip()
    if not text:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        value = {"mermaid": text}
    found = value.get("mermaid") if isinstance(value, dict) else None
    if not isinstance(found, str):
        return None
    lines = found.strip().splitlines()
    if lines and lines[0].lstrip().startswith("```"):
        lines = lines[1:-1] if len(lines) > 1 and lines[-1].lstrip().startswith("```") else lines[1:]
    return "\n".join(lines).replace("`", "").strip() or None
