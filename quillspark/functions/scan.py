"""Scanning primitives over one document's text, shared by every Markdown operator.

Two ideas replace character loops.  A *token stream* is one regex pass whose first
alternative swallows a backslash with the character behind it, so what the other
alternatives see is never escaped.  A *fenced rewrite* walks lines once and lets a
pass change only those outside fenced blocks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

FENCE_OPEN = re.compile(r"([ \t]*)(`{3,}|~{3,})")
FENCE_ONLY = re.compile(r"[ \t]*(`{3,}|~{3,})[ \t]*")
FENCE_TOKEN = re.compile(r"`{3,}|~{3,}")
LIST_ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+")
GLUE_LANGUAGE = re.compile(r"[A-Za-z0-9_-]+")


def fenced(text: str) -> bool:
    """Whether fence characters stand anywhere; without them there is nothing for a pass over fences to do."""
    return "```" in text or "~~~" in text


def opener(line: str) -> str | None:
    """The fence characters with which a line opens a block."""
    found = FENCE_OPEN.match(line) if fenced(line) else None
    return found[2] if found else None


def closes(line: str, fence: str) -> bool:
    """Whether a line ends the block that ``fence`` opened: nothing else, same character, no shorter."""
    found = FENCE_ONLY.fullmatch(line) if fence in line else None
    return bool(found) and found[1][0] == fence[0] and len(found[1]) >= len(fence)


def fence_only(line: str, fence: str = "") -> bool:
    return fenced(line) and FENCE_ONLY.fullmatch(line) is not None


def rewrite_outside(lines: Iterable[str], change: Callable[[str], list[str]], ends: Callable[[str, str], bool] = closes) -> list[str]:
    """Apply ``change`` to each line outside fenced blocks; the last line it gives may open one."""
    out: list[str] = []
    fence = None
    for line in lines:
        if fence:
            out.append(line)
            if ends(line, fence):
                fence = None
            continue
        out += (new := change(line))
        fence = opener(new[-1]) if new else None
    return out


def inside_fence(lines: Iterable[str]) -> list[bool]:
    """For every line, whether a block is open before it (closing lines are inside, opening ones aren't)."""
    out, fence = [], None
    for line in lines:
        out.append(fence is not None)
        if fence is None:
            fence = opener(line)
        elif closes(line, fence):
            fence = None
    return out


def width(indent: str) -> int:
    """Columns of an indentation; a tab counts four."""
    return len(indent) + 3 * indent.count("\t")


def indent_of(line: str) -> str:
    return line[: len(line) - len(line.lstrip(" \t"))]


def code_ranges(line: str) -> list[tuple[int, int]]:
    """Inline code of one line: a run of ticks up to the next run of the same length; others inside don't count."""
    out, open_run = [], None
    for run in re.finditer("`+", line):
        if open_run is None:
            open_run = run
        elif len(run[0]) == len(open_run[0]):
            out.append((open_run.start(), run.end()))
            open_run = None
    return out


def in_ranges(ranges: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b in ranges)


def mid_line_fences(line: str, pattern: re.Pattern = FENCE_TOKEN) -> Iterator[re.Match]:
    """Fence tokens behind other text and outside inline code."""
    if fenced(line):
        code, first = code_ranges(line), len(line) - len(line.lstrip())
        for token in pattern.finditer(line):
            if token.start() > first and not in_ranges(code, *token.span()):
                yield token


def glued_fence(line: str) -> int | None:
    """Where a fence with a language begins right behind prose."""
    for token in mid_line_fences(line):
        if not line[token.start() - 1].isspace() and GLUE_LANGUAGE.match(line, token.end()):
            return token.start()
    return None


def keep_final_newline(given: str, result: str) -> str:
    """End with a newline exactly when the given text did."""
    if given.endswith("\n"):
        return result if result.endswith("\n") else result + "\n"
    return result.rstrip("\n")


def by_line(change: Callable[[list[str]], list[str]]) -> Callable[[str], str]:
    """A text function from a function of lines; texts without lines stay as they are."""

    def run(text: str) -> str:
        lines = text.splitlines()
        return keep_final_newline(text, "\n".join(change(lines))) if lines else text

    return run


def settled(text: str, passes: int) -> str:
    """What passes over lines that change none make of a text: single newlines, and of several final ones each pass takes one."""
    for _ in range(passes):
        if (new := by_line(lambda lines: lines)(text)) == text:
            break
        text = new
    return text


def excerpt(line: str) -> str:
    compact = line.strip()
    return compact if len(compact) <= 120 else compact[:117] + "..."


def tokens(text: str, pattern: str) -> Iterator[tuple[int, str]]:
    """Position and text of every unescaped match; escaped pairs are given too, with their backslash."""
    for m in re.finditer(rf"\\[\s\S]|{pattern}", text):
        yield m.start(), m[0]


class Escapes:
    """Which positions of a text stand behind an odd number of backslashes."""

    def __init__(self, text: str):
        self.at = {k for run in re.finditer(r"\\+", text) for k in range(run.start() + 1, run.end() + 1, 2)} if "\\" in text else frozenset()

    def __contains__(self, position: int) -> bool:
        return position in self.at


class Spans:
    """Disjoint half-open intervals, kept in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[str] = []

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] > start or k < len(self.starts) and self.starts[k] < end

    def holds(self, position: int) -> bool:
        return self.overlaps(position, position + 1)

    def add(self, start: int, end: int, kind: str) -> None:
        """Insert unless it overlaps one that is there."""
        if not self.overlaps(start, end):
            k = bisect_right(self.starts, start)
            self.starts.insert(k, start)
            self.ends.insert(k, end)
            self.kinds.insert(k, kind)

    def rows(self) -> list[tuple[int, int, str]]:
        return list(zip(self.starts, self.ends, self.kinds, strict=True))
