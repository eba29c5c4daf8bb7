"""Main-text extraction from whole HTML pages.

The standard library's parser streams events.  Block elements cut the page into
lines; each line keeps its text, how much of it is linked, how many tags it holds and
the elements in which it stands.  Elements that by tag or role are a menu, page header,
footer, sidebar, script or comment section yield no lines: their text may be as dense as an
article's.  A form, or a block that a word of its class or id marks as a notice, advert or the like, is taken
out too, unless it holds more than half of the page's unlinked text: then it is no such thing.  Inline
elements are never marked, so no sentence loses a word.

Of the remaining lines the ratios of unlinked text to tags are smoothed by a Gaussian;
lines over a threshold (the deviation of the smoothed ratios, the mean at most) form
clusters: the content regions.  A region grows to the whole of the ``article`` or
``main`` element in which it stands; elsewhere all grow to the innermost element that
holds every dense line (but for lines shorter than the threshold that only their
neighbours make dense).  What no region reaches - menus, link lists and footers that nothing marks -
goes, and so does a run of link lines at an edge of what is kept unless all of it is dense or a
heading or a colon introduces it.  Nothing else in a region is left out, so short
paragraphs and lists of links stay.

Defined cases: null and empty pages, and pages without visible content, give an empty
text; unclosed elements end where an outer one does; a tag or comment that the page's
end cuts off is none, a marked section a comment; repeated rows are alike; an empty
table gives no rows.  Time grows with the page's length, whatever its markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import col, id_type

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never content, whatever stands in them.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select option textarea input label fieldset iframe object svg canvas audio video menu dialog".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open element an opening tag ends, as HTML has it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
#: Words of a class or id that mark an element that isn't content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " header masthead topbar footer foot bottombar copyright sidebar aside rail widget widgets related recommended recommendations trending cookie cookies consent gdpr notice notices notification"
    " alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies disqus discussion pagination pager toolbar skip skiplink".split()
)
#: Words of a class or id that hold such a word although the element is content.
CONTENT = frozenset("article content main body post entry story text".split())
#: Classes of an article that is a reader's comment.
COMMENTS = frozenset("comment comment-body comment-content reply".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


#: Marks of lines about an article, not of it.
BYLINES = frozenset("byline dateline author meta published".split())
#: Marks of what readers wrote, which may well be longer than the article.
READERS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())


def mark_of(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> str:
    """What an element and all that it holds is, by tag, role, class or id: ``no`` content, ``maybe`` none, or nothing that is known."""
    if tag in DROPPED or tag == "header" and not in_article:
        return "no"
    if tag == "article":  # readers' comments are often articles themselves
        return "no" if any(name == "class" and value and not COMMENTS.isdisjoint(value.lower().split()) for name, value in attrs) else ""
    found = "maybe" if tag == "form" else ""
    for name, value in attrs:
        if name in ("hidden", "inert") or value and name == "aria-hidden" and value.strip().lower() == "true":
            return "no"
        if value and name == "role" and value.strip().lower() in ROLES:
            return "no"
        if value and name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "no"
        if value and name in ("class", "id") and tag in BLOCKS and tag not in ("html", "body", "main"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                last = bool(words) and words[-1] in MARKS and not (in_article and words[-1] == "header")
                if in_article and words and words[-1] in BYLINES:
                    return "no"
                if last or len(words) > 1 and words[0] in MARKS and words[-1] not in CONTENT:
                    if words[-1 if last else 0] in READERS:
                        return "no"
                    found = "maybe"
    return found


class Line(NamedTuple):
    text: str
    linked: int  # characters of it that stand in links
    tags: int
    article: int  # the number of the article or main around it, 0 if there is none
    parent: int  # the number of the container around it
    heads: bool  # whether it is a heading
    marked: int  # the number of the outermost element around it that may be no content, 0 if there is none


class Lines(HTMLParser):
    """The block lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag and own number
        self.where: dict[str, list[int]] = {}  # places of the open elements of a tag
        self.blocks: list[int] = []  # places of the open blocks
        self.parents: list[int] = [0]  # numbers of the open containers of lines
        self.number, self.skip, self.marked, self.articles = 0, 0, 0, []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[Line] = []
        self.outer, self.last = {0: 0}, {}  # by an element's number: that of the element around it, and the highest one inside it

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def finish(self) -> None:
        if re.match("<[A-Za-z/!?]", self.rawdata):
            self.rawdata = ""  # a tag or comment without an end
        self.close()
        self.flush()
        self.close_to(0)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.linked, self.tags, self.articles[-1] if self.articles else 0, self.parents[-1], any(self.where.get(h) for h in HEADINGS), self.marked))
                self.tags = self.linked = 0
            self.parts = []

    def close_to(self, k: int) -> None:
        """End the open elements from the k-th on."""
        while len(self.open) > k:
            tag, number = self.open.pop()
            self.where[tag].pop()
            self.last[number] = self.number
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            if self.parents[-1] == number:
                self.parents.pop()
            if self.skip == number:
                self.skip = 0
            if self.articles and self.articles[-1] == number:
                self.articles.pop()
            if self.marked == number:
                self.marked = 0

    def place(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these tags stands, -1 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS or tag in DROPPED or tag == "form"
        if block:
            self.flush()
            if tag in ENDS:
                ended = self.place(ENDS[tag])
                if ended > self.place(SCOPES[tag] - ENDS[tag]):
                    self.close_to(ended)
            elif tag in BLOCKS and self.blocks and self.open[self.blocks[-1]][0] == "p":
                self.close_to(self.blocks[-1])  # a block ends an open paragraph and what is open in it
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        self.number += 1
        mark = "" if self.skip else mark_of(tag, attrs, bool(self.articles))
        if mark == "no":
            self.skip = self.number
        elif mark and not self.marked:
            self.marked = self.number
        if not self.skip and tag in ("article", "main"):
            self.articles.append(self.number)
        self.outer[self.number] = self.open[-1][1] if self.open else 0
        self.where.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        if tag in BLOCKS and tag not in ("p", "li") and tag not in HEADINGS:
            self.parents.append(self.number)
        self.open.append((tag, self.number))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash says nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in DROPPED or tag == "form":
            self.flush()
        self.tags += 1
        if (k := self.place((tag,))) >= 0:
            self.close_to(k)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.where.get("a"):
                self.linked += len(data.strip())


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights that fall off the ends are shared by the rest."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    both = [np.convolve(x, weights)[reach : reach + values.size] for x in (values, np.ones(values.size))]
    return both[0] / both[1]


def dense_lines(lines: list[Line]) -> tuple[np.ndarray, float]:
    """Which lines have a smoothed ratio of unlinked text to tags over the threshold, and the threshold."""
    smooth = smoothed(np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]))
    limit = min(smooth.std(), smooth.mean())
    return smooth >= limit, float(limit)


def unmarked(lines: list[Line]) -> list[Line]:
    """The lines without those of marked elements, but for an element with more than half of the page's unlinked text."""
    held: dict[int, int] = {}
    for x in lines:
        held[x.marked] = held.get(x.marked, 0) + max(0, len(x.text) - x.linked)
    every = sum(held.values())
    return [x for x in lines if not x.marked or 2 * held[x.marked] > every]


def without_link_edges(lines: list[Line], dense: np.ndarray, kept: list[int]) -> list[int]:
    """``kept`` without the runs of link lines at its ends that aren't dense and that nothing introduces."""
    linked = [2 * lines[k].linked > len(lines[k].text) for k in kept]
    first = next((k for k, is_link in enumerate(linked) if not is_link), 0)  # only links: all stay
    last = len(kept) - next((k for k, is_link in enumerate(reversed(linked)) if not is_link), 0)
    if all(dense[k] for k in kept[:first]):
        first = 0
    if all(dense[k] for k in kept[last:]) or lines[kept[last - 1]].heads or lines[kept[last - 1]].text.endswith(":"):
        last = len(kept)
    return kept[first:last]


def content_lines(lines: list[Line], outer: dict[int, int], last: dict[int, int]) -> list[str]:
    """The text of the lines of all content regions; elements are numbered in page order, so those inside one are a range."""
    lines = unmarked(lines)
    if not lines:
        return []
    dense, limit = dense_lines(lines)
    articles = {x.article for x, d in zip(lines, dense, strict=True) if d and x.article}
    if articles:
        kept = [k for k, x in enumerate(lines) if x.article in articles]
        return [lines[k].text for k in without_link_edges(lines, dense, kept)]
    length: dict[int, int] = {}
    for x, d in zip(lines, dense, strict=True):
        if d:
            length[x.parent] = length.get(x.parent, 0) + len(x.text)
    # Lines dense by their neighbours alone, like a row of links after the content, don't widen the region; inside it they stay.
    least = min(limit, max(length.values(), default=0) / 4)
    parents = [p for p, n in length.items() if n >= least]
    if not parents:
        return []
    root, end = min(parents), max(parents)
    while root and last[root] < end:
        root = outer[root]
    kept = [k for k, x in enumerate(lines) if not root or root <= x.parent <= last[root]]
    return [lines[k].text for k in without_link_edges(lines, dense, kept)]


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks in page order, a line each."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.finish()
    return "\n".join(content_lines(parser.lines, parser.outer, parser.last))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {id_type(pages, id_col)}, url string, text string, n_chars long")
