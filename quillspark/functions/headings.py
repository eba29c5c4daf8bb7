"""Headings that stand behind other text on their line."""

from __future__ import annotations

# What a heading may be glued to (a rule, a quote, an item, a numbered item, the end of a sentence),
# whether that begins a line, and the least number of the heading's marks.
GLUED_TO = (
    (r"([=]{3,}|[-]{3,})\s*", True, 1),
    (r"(>[^\n]*?)", True, 1),
    (r"([ \t]*[-*+]\s+[^\n]*?)", True, 1),
    (r"([ \t]*\d+[.)]\s+[^\n]*?)", True, 1),
    (r"([.!?。！？\]\)])\s*", False, 2),
)


def patterns(line_flags: str, flags: str) -> list[str]:
    """One pattern a case, with what stands before as group 1 and the heading's marks as group 2."""
    return [f"{line_flags if at_start else flags}{'^' if at_start else ''}{before}(#{{{least},6}}\\s+)" for before, at_start, least in GLUED_TO]
