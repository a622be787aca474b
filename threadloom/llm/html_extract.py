"""Main text of web pages by the text-to-tag ratio of their lines.

The standard library's streaming parser turns a page into lines, one for each block of
text, with the number of tags in it, its share of link text and the container that it
stands in. The ratio of text without links to tags is smoothed over neighbouring lines by a Gaussian, and
lines over a threshold form the content cluster. Content regions are then the containers
that gather the most text of the cluster: text in it counts for a container and link text
outside it against it, and a container is taken whole or as the best of the containers in
it. Names of elements and classes are features of a line: menus, forms, comments and the
like have no ratio and never are content, headings and lines of article and main elements
count for their container. All other lines of a region are the page's text, but for runs of
links outside article and main elements.

Defined results: a null or empty page, or one without text in its body, gives ''; broken
markup is read as far as it goes; pages of any length and depth are read whole, in time and
memory that grow with their length; repeated rows get equal rows; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video map datalist".split())
ASIDE = frozenset("nav header footer aside form button select option textarea fieldset label menu dialog search".split())
MAIN = frozenset(("article", "main"))
#: Elements that can hold a whole story; a paragraph, heading, list or quotation is a part of one.
CONTAINERS = frozenset("article body center div html main section td".split())
# Classes, ids and roles, as whole names, of what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser teasers toolbar widget widgets"
    " ad-banner ad-slot comment-form comment-list comments-area cookie-banner cookie-notice main-menu main-nav nav-menu page-footer related-posts share-buttons site-footer site-header site-nav social-links".split()
)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_CLOSES_P = BLOCKS - {"option", "optgroup", "legend", "caption"}
_SCOPES = frozenset(("table", "ul", "ol", "dl", "select", "body", "html", "template", "td", "th"))
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_WHITE = re.compile(r"\s+")
MOST = 100.0  # characters a tag, beyond which a line is only text
RUN = 3  # so many lines of links on end are a menu


class Line(NamedTuple):
    """A block of text: how many tags and characters of links are in it, its container, and its features."""

    text: str
    tags: int
    linked: int
    container: int
    aside: bool
    main: bool
    heading: bool


class Element(NamedTuple):
    """An open element; its flags hold for all that it contains."""

    name: str
    container: int
    hidden: bool
    aside: bool
    main: bool


_PAGE = Element("", 0, False, False, False)


_COMMENT_END = re.compile(r"--!?\s*>")
#: The words that may begin a marked section.
_SECTION = re.compile(r"<!\[\s*(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.IGNORECASE)


class PageLines(HTMLParser):
    """Collects ``lines`` and, for each container, the one around it (``outer``; the page itself is 0)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # where elements of a name are open
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.outer = [0]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def goahead(self, end: bool) -> None:
        """Notes where the last tag and the last comment can end, so that what is never closed isn't searched to the page's end each time."""
        self.last_end = self.rawdata.rfind(">")
        self.last_comment_end = max((m.start() for m in _COMMENT_END.finditer(self.rawdata)), default=-1)
        super().goahead(end)

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if i < self.last_end else -1

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if i < self.last_end else -1

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if i < self.last_end else -1

    def parse_comment(self, i: int, report: bool = True) -> int:
        return super().parse_comment(i, report) if i < self.last_comment_end else -1

    def parse_html_declaration(self, i: int) -> int:
        return super().parse_html_declaration(i) if i < self.last_end else -1

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        """Sections that the standard parser doesn't know are comments up to the next end of a tag, as browsers read them."""
        known = _SECTION.match(self.rawdata, i)
        return super().parse_marked_section(i, report) if known else self.parse_bogus_comment(i, report)

    def end_line(self) -> None:
        text = _WHITE.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.open[-1] if self.open else _PAGE
            self.lines.append(Line(text, self.tags, self.linked, top.container, top.aside, top.main, any(self.at[h] for h in _HEADINGS)))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            if tag in _CLOSES_P and self.at["p"] and self.blocks[-1] == self.at["p"][-1]:
                self._close_from(self.at["p"][-1])
            if closed := [self.at[name][-1] for name in _CLOSED_BY.get(tag, ()) if self.at[name]]:
                if max(closed) >= (self.scopes[-1] if self.scopes else 0):
                    self._close_from(max(closed))
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        given = dict(attrs)
        named = {w.rstrip("0123456789-_") for a in ("class", "id", "role") for w in (given.get(a) or "").lower().split()}
        top = self.open[-1] if self.open else _PAGE
        hidden = top.hidden or tag in HIDDEN or "hidden" in given or (given.get("style") or "").replace(" ", "").lower().startswith("display:none")
        aside = tag in ASIDE and not (tag == "header" and top.main) or bool(named & ASIDE_WORDS) and tag not in ("html", "body", "article", "main")
        main = tag in MAIN or given.get("role") in ("main", "article")
        container = top.container
        if tag in CONTAINERS:
            self.outer.append(container)
            container = len(self.outer) - 1
        for stack, own in ((self.at[tag], True), (self.blocks, tag in BLOCKS), (self.scopes, tag in _SCOPES)):
            if own:
                stack.append(len(self.open))
        self.open.append(Element(tag, container, hidden, top.aside or aside, top.main or main))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def _close_from(self, first: int) -> None:
        """Ends all elements from the ``first`` on."""
        if self.blocks and self.blocks[-1] >= first:
            self.end_line()
        for e in self.open[first:]:
            self.at[e.name].pop()
        for stack in (self.blocks, self.scopes):
            while stack and stack[-1] >= first:
                stack.pop()
        del self.open[first:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.at[tag]:
            self._close_from(self.at[tag][-1])
        elif tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1].hidden):
            self.parts.append(data)
            if self.at["a"]:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.end_line()


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and its weights sum to one."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratio) / full(np.ones(len(ratio)))


def content_regions(weights: list[float], containers: list[int], outer: list[int]) -> list[bool]:
    """For each container, whether it lies in a content region; ``weights`` are of lines, ``containers`` those they stand in.

    A container is a region if it gathers more than the best regions inside it, or as much
    as several of them, and if that is more than nothing.
    """
    own, inner, parts = [0.0] * len(outer), [0.0] * len(outer), [0] * len(outer)
    for w, c in zip(weights, containers, strict=True):
        own[c] += w
    whole = [False] * len(outer)
    for c in range(len(outer) - 1, -1, -1):  # inner ones come after outer ones
        whole[c] = own[c] > 0 and (own[c] > inner[c] or own[c] == inner[c] and parts[c] > 1)
        best = own[c] if whole[c] else inner[c]
        if c:
            own[outer[c]] += own[c]
            inner[outer[c]] += best
            parts[outer[c]] += best > 0
    for c in range(1, len(outer)):
        whole[c] = whole[c] or whole[outer[c]]
    return whole


def main_text(html: str | None, sigma: float = 1.0, spread: float = 0.5) -> str:
    """The page's main text: blocks in page order, joined by empty lines.

    ``spread``: lines belong to the content cluster whose smoothed ratio reaches this many
    standard deviations of all ratios, or that of the largest, and that reach a quarter of
    it by themselves.
    """
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    lines = page.lines
    if not lines:
        return ""
    ratio = np.array([0.0 if x.aside else min(MOST, max(0, len(x.text) - x.linked) / max(1, x.tags)) for x in lines])
    smooth = smoothed(ratio, sigma)
    least = min(spread * ratio.std(), smooth.max())
    cluster = ((smooth >= least) & (4 * ratio >= least)).tolist()
    menu = [not (x.aside or x.main) and 2 * x.linked > len(x.text) and r < max(least, 1e-9) for x, r in zip(lines, ratio.tolist(), strict=True)]
    weight = [0.0 if x.aside else -float(len(x.text)) if m else len(x.text) * float(on or x.main or x.heading) for x, on, m in zip(lines, cluster, menu, strict=True)]
    inside = content_regions(weight, [x.container for x in lines], page.outer)
    if not any(inside):
        return "\n\n".join(x.text for x in lines if not x.aside)
    out, links = [], []
    for x, m in zip(lines, menu, strict=True):
        if m and inside[x.container]:
            links.append(x.text)
            continue
        if len(links) < RUN:
            out += links
        links = []
        if inside[x.container] and not x.aside:
            out.append(x.text)
    return "\n\n".join(out + links if len(links) < RUN else out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    done = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
