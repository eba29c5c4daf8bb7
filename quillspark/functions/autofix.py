"""Structural repair of Markdown: passes that each remove what one lint rule finds."""

from __future__ import annotations

import re

from quillspark.functions.lint import Issue, lint, report
from quillspark.functions.scan import FENCE_TOKEN, LIST_ITEM, by_line, closes, code_ranges, fenced, glued_fence, in_ranges, indent_of, mid_line_fences, opener, rewrite_outside, settled, width

TICKS = re.compile(r"`{3,}([A-Za-z0-9_-]+)?")
PLAIN_BLOCK = re.compile(r"[`~]{3,}(?:plaintext|text)\b", re.IGNORECASE)
LOOK_AHEAD = 3


def _split_glue(line: str) -> list[str]:
    at = glued_fence(line)
    return [line] if at is None else [line[:at].rstrip(), line[at:].lstrip()]


def _split_item(line: str) -> list[str]:
    """A fence in a list item moves to a line of its own, indented as the item's content."""
    item = LIST_ITEM.match(line) if fenced(line) and not opener(line) else None
    token = next((t for t in mid_line_fences(line, FENCE_TOKEN) if t.start() >= item.end()), None) if item else None
    if token is None:
        return [line]
    return [line[: token.start()].rstrip(), " " * (width(item[1]) + 4) + line[token.start() :].strip()]


def _spell_ticks(line: str) -> list[str]:
    """Literal ticks in prose are spelled out."""
    if "```" not in line or opener(line):
        return [line]
    code, first = code_ranges(line), len(line) - len(line.lstrip())

    def spelled(m: re.Match) -> str:
        if m.start() <= first or in_ranges(code, *m.span()):
            return m[0]
        return f"triple backticks ({m[1]})" if m[1] else "triple backticks"

    return [TICKS.sub(spelled, line)]


def block_end(lines: list[str], start: int) -> int:
    """The line that closes the block opened at ``start``, or the last line."""
    fence = opener(lines[start])
    return next((k for k in range(start + 1, len(lines)) if closes(lines[k], fence)), len(lines) - 1)


def _indent_list_blocks(lines: list[str]) -> list[str]:
    """Blocks right under a list item's content get the indentation of content, line by line."""
    out: list[str] = []
    content, k = None, 0  # content: columns of the current item's content
    while k < len(lines):
        line = lines[k]
        if item := LIST_ITEM.match(line):
            content = width(item[1]) + 4
        elif content is not None and opener(line):
            pad, end = " " * content, block_end(lines, k)
            out.append(pad + line.lstrip() if width(indent_of(line)) < content else line)
            for inner in lines[k + 1 : end + 1]:
                if not inner.strip():
                    out.append(inner if inner.startswith(pad) else "")
                else:
                    out.append(inner if width(indent_of(inner)) >= content else pad + inner.lstrip(" \t"))
            k = end + 1
            continue
        elif content is not None and line.strip() and width(indent_of(line)) < content:
            content = None
        out.append(line)
        k += 1
    return out


def _reindent(lines: list[str], start: int, end: int, columns: int) -> None:
    """Replace the opener's indentation by ``columns`` spaces on every line of a block."""
    own = indent_of(lines[start])
    for k in range(start, end + 1):
        line = lines[k]
        bare = line[len(own) :] if line.startswith(own) else line.lstrip(" \t")
        lines[k] = " " * columns + bare if line.strip() else ""


def _calm_risky_blocks(max_depth: int):
    """Blocks that lint calls risky under lists move left: too deep ones to the safe depth, chained ones out."""

    def run(lines: list[str]) -> list[str]:
        if not any(LIST_ITEM.match(x) for x in lines):
            return lines
        rules: dict[int, set[str]] = {}
        for issue in lint("\n".join(lines), True, max_depth):
            if issue.rule_id.startswith("LIST_FENCE_"):
                rules.setdefault(issue.line - 1, set()).add(issue.rule_id)
        out, done = list(lines), set()
        for at, found in sorted(rules.items()):
            start = next((k for k in range(at, min(len(out), at + LOOK_AHEAD + 1)) if opener(out[k])), None)
            if start is None or start in done:
                continue
            done.add(start)
            columns = width(indent_of(out[start]))
            if "LIST_FENCE_COMPLEX_DEPTH" in found:
                columns = min(columns, max_depth * 4)
            if "LIST_FENCE_CHAINING" in found:
                columns = 0
            _reindent(out, start, block_end(out, start), columns)
        return out

    return run


def _limit_plain_blocks(lines: list[str]) -> list[str]:
    """Plain-text blocks stand at most four columns deep."""
    out, k = list(lines), 0
    while k < len(out):
        if opener(out[k]) and PLAIN_BLOCK.match(out[k].strip()) and width(indent_of(out[k])) > 4:
            end = block_end(out, k)
            _reindent(out, k, end, 4)
            k = end
        k += 1
    return out


indent_list_blocks = by_line(_indent_list_blocks)


def autofix(text: str, strict: bool = True, max_depth: int = 1) -> str:
    """All repairs; the last two only for strict renderers."""
    passes = [
        lambda x: rewrite_outside(x, _split_glue), lambda x: rewrite_outside(x, _split_item), _indent_list_blocks, lambda x: rewrite_outside(x, _spell_ticks),
    ]
    if strict:
        passes += [_calm_risky_blocks(max(1, max_depth)), _limit_plain_blocks]
    if not fenced(text):
        return settled(text, len(passes))
    for change in passes:
        text = by_line(change)(text)
    return text


def guard(text: str, strict: bool = True, max_depth: int = 1) -> tuple[str, list[Issue], str | None]:
    """Repair, at most twice, until lint finds nothing: the text, what is left, and the error if anything is."""
    for _ in range(2):
        text = autofix(text, strict, max_depth)
        if not (issues := lint(text, strict, max_depth)):
            return text, [], None
    return text, issues, f"markdown guardrails failed:\n{report(issues)}"
