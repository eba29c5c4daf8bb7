"""Structural lint: one scan states facts of every line, rules are predicates over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from quillspark.functions.sanitize import RESIDUE, may_have_residue
from quillspark.functions.scan import GLUE_LANGUAGE, LIST_ITEM, closes, excerpt, fenced, indent_of, mid_line_fences, opener, width

# Rule names and messages.
MESSAGES = {
    "BROKEN_LINK_EMPTY_LABEL": "malformed empty-label markdown link",
    "INTERACTIVE_RESIDUE": "interactive exercise residue found",
    "LIST_CONTEXT_DRIFT": "list marker style changed at same indentation level",
    "FENCE_GLUE_AFTER_PROSE": "fenced block opener is glued to prose",
    "PROSE_TRIPLE_BACKTICKS": "literal triple backticks found in prose",
    "FENCE_INLINE": "fence marker appears mid-line",
    "LIST_FENCE_INDENT": "fenced block under list item is not indented correctly",
    "LIST_FENCE_COMPLEX_DEPTH": "fenced block under deep list context (depth={depth}, max={most})",
    "LIST_FENCE_CHAINING": "adjacent fenced blocks under list context are rendering-risky",
    "FENCE_UNBALANCED": "opening fence is not closed",
}
BROKEN_LINK = re.compile(r"\[]\(https?://[^)\s]+\)(?=\S)")
STRICT_ONLY = frozenset({"BROKEN_LINK_EMPTY_LABEL", "INTERACTIVE_RESIDUE", "LIST_CONTEXT_DRIFT", "FENCE_GLUE_AFTER_PROSE", "LIST_FENCE_COMPLEX_DEPTH", "LIST_FENCE_CHAINING"})
CLEAN_REPORT = "No markdown lint issues."


class Issue(NamedTuple):
    rule_id: str
    line: int
    message: str
    excerpt: str


class Line(NamedTuple):
    """What the rules need to know of a line outside fences, and of an opener."""

    number: int
    text: str
    is_item: bool
    drifts: bool  # the marker's kind differs from its predecessor's at this indentation
    fence: str | None  # the fence that it opens
    closed: bool  # whether that fence is closed
    indent: int
    depth: int  # list levels that hold the opened block
    wanted: int  # least indentation of a block there
    after_list_block: bool  # the line before, blank ones aside, closed a block in a list


class Lists:
    """The open list levels: indentation and kind of marker of each."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, bool]] = []

    def item(self, indent: int, ordered: bool) -> bool:
        """Enter an item; true if its marker's kind changed."""
        self.levels = [x for x in self.levels if x[0] <= indent]
        before = self.levels[-1] if self.levels and self.levels[-1][0] == indent else None
        self.levels = [*(self.levels[:-1] if before else self.levels), (indent, ordered)]
        return before is not None and before[1] != ordered

    def leave(self, indent: int) -> None:
        """Prose ends the levels whose content it isn't indented enough for."""
        while self.levels and indent < self.levels[-1][0] + 4:
            self.levels.pop()

    def depth(self, indent: int) -> int:
        return next((k for k, x in enumerate(self.levels) if indent < x[0] + 4), len(self.levels))


def scan(text: str) -> Iterator[Line]:
    """The lines outside fences, with openers; list levels persist through blocks and blank lines."""
    lists, fence, in_list, near, pending = Lists(), None, False, "", None
    for number, line in enumerate(text.splitlines(), 1):
        if fence:
            if closes(line, fence):
                yield pending._replace(closed=True)
                fence, near = None, "list block" if in_list else "block"
            continue
        item, fence = LIST_ITEM.match(line), opener(line)
        indent = width(indent_of(line))
        drifts = bool(item) and lists.item(width(item[1]), item[2][0].isdigit())
        if not item and not fence and line.strip():
            lists.leave(indent)
        depth = wanted = 0
        if fence:
            explicit = lists.depth(indent)
            depth = explicit or (len(lists.levels) if near in ("item", "content", "list block") else 0)
            wanted = lists.levels[depth - 1][0] + 4 if depth else 0
            in_list = depth > 0
        facts = Line(number, line, bool(item), drifts, fence, False, indent, depth, wanted, near == "list block")
        if fence:
            pending = facts
            continue
        yield facts
        if line.strip():
            near = "item" if item else "content" if lists.levels else "prose"
    if fence:
        yield pending


def _token_rule(line: Line, strict: bool) -> str | None:
    """The first fence token in the middle of a line decides."""
    for token in mid_line_fences(line.text):
        ticks = token[0][0] == "`"
        if strict and ticks and not line.text[token.start() - 1].isspace() and GLUE_LANGUAGE.match(line.text, token.end()):
            return "FENCE_GLUE_AFTER_PROSE"
        return "PROSE_TRIPLE_BACKTICKS" if ticks and not line.is_item else "FENCE_INLINE"
    return None


def lint(text: str, strict: bool = True, max_depth: int = 1) -> list[Issue]:
    """All issues in order of line, unclosed fences last."""
    most, out, last, residue = max(1, max_depth), [], [], may_have_residue(text)
    if not (residue or fenced(text) or "[](" in text or any(LIST_ITEM.match(x) for x in text.splitlines())):
        return []  # no line that a rule speaks of
    for line in scan(text):
        token = _token_rule(line, strict) if fenced(line.text) else None
        if not (residue or line.drifts or token or line.fence or "[](" in line.text):
            continue
        rules = {
            "BROKEN_LINK_EMPTY_LABEL": BROKEN_LINK.search(line.text),
            "INTERACTIVE_RESIDUE": residue and RESIDUE.search(line.text),
            "LIST_CONTEXT_DRIFT": line.drifts,
            token: True,
            "LIST_FENCE_INDENT": line.depth and line.indent < line.wanted,
            "LIST_FENCE_COMPLEX_DEPTH": line.depth > most,
            "LIST_FENCE_CHAINING": line.depth and line.after_list_block,
        }
        broken = [r for r, holds in rules.items() if r and holds and (strict or r not in STRICT_ONLY)]
        out += [Issue(r, line.number, MESSAGES[r].format(depth=line.depth, most=most), excerpt(line.text)) for r in broken]
        if line.fence and not line.closed:
            last.append(Issue("FENCE_UNBALANCED", line.number, MESSAGES["FENCE_UNBALANCED"], excerpt(line.text)))
    return out + last


def report(issues: list[Issue]) -> str:
    return "\n".join(f"{i.rule_id} line {i.line}: {i.message} | {i.excerpt}" for i in issues) or CLEAN_REPORT
