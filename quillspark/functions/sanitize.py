"""Cleaning of incoming Markdown: seven passes over lines, in a fixed order."""

from __future__ import annotations

import re

from quillspark.functions.scan import closes, fence_only, fenced, glued_fence, inside_fence, keep_final_newline, opener, rewrite_outside

# Patterns of what upstream sources leave behind.
LABELLED_ANCHOR = re.compile(r"\[]\((https?://[^)\s]+)\)(\S[^\n]*)")
BARE_ANCHOR = re.compile(r"\[]\(https?://[^)\s]+\)")
ANY_ANCHOR = re.compile(r"\[]\(https?://[^)]+\)\s*")
EXERCISE = re.compile(r"#@ex-[A-Za-z0-9_-]+", re.IGNORECASE)
RESIDUE = re.compile(r"check explain|\(missing answer\)|\(missing explanation\)|（缺失答案）|（缺失解释）", re.IGNORECASE)
REQUIRES = re.compile(r"(.*\brequires:\s*)(.*?)(\beffects:\s*.+)", re.IGNORECASE)
OVERLONG = re.compile(r"([ \t]*)(`{4,}|~{4,})([A-Za-z0-9_-]+)[ \t]*")
DOUBLE_FENCE = re.compile(r"^(`{6,}|~{6,})$", re.MULTILINE)
LOOK_BACK, MOST_BLANKS = 120, 2
#: Letters that patterns without case take for i, k and s, and ``lower`` doesn't.
ODD_LETTERS = "\u0130\u0131\u017f\u212a"


def may_hold(text: str, *words: str) -> bool:
    """Whether one of some lower-case words can stand in a text, in whatever case; true in doubt."""
    low = text.lower()
    return any(w in low for w in words) or not text.isascii() and any(c in text for c in ODD_LETTERS)


def may_have_residue(text: str) -> bool:
    return may_hold(text, "check explain", "(missing ", "（缺失", "#@ex-")


def split_double_fences(text: str) -> str:
    """An unindented line of six fence characters or more becomes two fences of half as many."""
    if "``````" not in text and "~~~~~~" not in text:
        return text
    return DOUBLE_FENCE.sub(lambda m: "\n".join([m[1][: len(m[1]) // 2]] * 2), text)


def clean_links(line: str) -> str:
    """Labels move into empty anchors in front of them; anchors without one go; adjacent links part."""

    def labelled(m: re.Match) -> str:
        label = m[2].strip()
        return label if label.startswith("[") else f"[{label}]({m[1]})"

    if "[](" in line:
        line = BARE_ANCHOR.sub("", LABELLED_ANCHOR.sub(labelled, line))
    return line.replace(")[", ") [").rstrip()


def drop_residue(lines: list[str]) -> list[str]:
    """Drop leftovers of interactive exercises outside fences.

    A line that says only "check explain" also drops everything back to the first
    leftover of its paragraph, at most 120 lines, and one blank line behind it.
    """
    if not may_have_residue("\n".join(lines)):
        return lines
    inside = inside_fence(lines)
    marked = [bool(EXERCISE.search(x) or RESIDUE.search(x)) for x in lines]
    dropped = {k for k, m in enumerate(marked) if m and not inside[k]}
    for k, line in enumerate(lines):
        if inside[k] or line.strip().lower() != "check explain":
            continue
        first = k
        for j in range(k, max(0, k - LOOK_BACK) - 1, -1):
            if inside[j] or not lines[j].strip():
                break
            first = j if marked[j] else first
        dropped |= set(range(first, k + 1))
        if k + 1 < len(lines) and not lines[k + 1].strip():
            dropped.add(k + 1)
    return [x for k, x in enumerate(lines) if k not in dropped]


def split_requires(line: str) -> list[str]:
    """One line with both clauses becomes one line each."""
    found = REQUIRES.match(line)
    return [line] if found is None else [(found[1].rstrip() + found[2].strip()).rstrip(), found[3].strip()]


def split_glued(line: str) -> list[str]:
    """Prose and the fence glued to it become two lines."""
    at = None if opener(line) else glued_fence(line)
    return [line] if at is None else [line[:at].rstrip(), line[at:].lstrip()]


def shorten_openers(lines: list[str]) -> list[str]:
    """An opener of four fence characters or more that only a shorter fence can close becomes one of three."""
    out, longest = [], {"`": 0, "~": 0}  # of the fence-only lines behind the current one
    for line in reversed(lines):
        if not fenced(line):
            out.append(line)
            continue
        found = OVERLONG.fullmatch(line)
        if found and 3 <= longest[found[2][0]] < len(found[2]):
            line = found[1] + found[2][0] * 3 + found[3]
        if fence_only(line):
            bare = line.strip(" \t")
            longest[bare[0]] = max(longest[bare[0]], len(bare))
        out.append(line)
    return out[::-1]


def collapse_blanks(lines: list[str]) -> list[str]:
    """At most two blank lines in a row outside fences."""
    out: list[str] = []
    run, fence = 0, None
    for line in lines:
        if fence:
            fence = None if closes(line, fence) else fence
        else:
            fence = opener(line)
            run = 0 if line.strip() else run + 1
            if run:
                if run <= MOST_BLANKS:
                    out.append("")
                continue
        out.append(line)
    return out


def sanitize(text: str, aggressive: bool = True) -> str:
    """All passes.  Line ends become single newlines; the final one stays or stays away."""
    if not text:
        return text
    lines = rewrite_outside(split_double_fences(text).splitlines(), lambda x: [clean_links(x)])
    if aggressive:
        lines = drop_residue(lines)
    held = "\n".join(lines)
    if may_hold(held, "requires:"):
        lines = rewrite_outside(lines, split_requires)
    if fenced(held):
        lines = rewrite_outside(lines, split_glued, ends=fence_only)
    return keep_final_newline(text, "\n".join(collapse_blanks(shorten_openers(lines))))


def clean_fetched(text: str) -> str:
    """After sanitizing: empty anchors go everywhere, and double fences are split once more."""
    return split_double_fences(ANY_ANCHOR.sub("", text) if "[](" in text else text)
