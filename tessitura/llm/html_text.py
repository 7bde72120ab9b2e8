"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events; block tags end a line. Every line has its text, its
tags, its link text and the container it stands in. The ratio of text to tags is smoothed over
neighbouring lines with a Gaussian kernel and split in two clusters; lines of the upper cluster
mark content, and the regions (containers) they stand in are returned whole, so short paragraphs
between long ones stay. ``<article>`` and ``<main>`` are evidence, not the answer: their lines count
as twice as dense, an article is one region and smoothing stops at its borders, but clusters choose
on every page. An article whose class, id or role names what is not main text counts only where it
holds more content than all other regions. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, known by tag, role, class or id, never count. Inside of an article,
though, paragraphs and headings are named for their looks, so their names say nothing, and names that an author
may give to a part of the text, a warning say, are evidence against it: such a part is a region of its own,
without the article's weight.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: HTML's void elements, elements that end a line, and elements that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("aside audio button canvas datalist dialog fieldset footer form frame frameset head iframe input label legend map menu nav noscript object optgroup option script search select style svg template textarea title video".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
#: Words in class, id or role that name what is not main text.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-social comment comments commentlist consent contentinfo cookie cookies copyright complementary dialog disclaimer disqus discussion feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted recommended related replies reply respond rail reactions search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar tracking warning widget widgets".split())
#: Of these, what a part of an article may be called too.
OWN = frozenset("disclaimer discussion feedback notice notices reactions search share tracking warning".split())
#: Elements that are parts of a text and not containers: in an article their names say nothing.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 a b i em strong span li dt dd td th tr code pre blockquote figcaption".split())
#: A page header is no main text, but the head of an article is.
HEADS = frozenset({"header", "topbar", "masthead", "site-header", "page-header"})
#: A start tag that ends open elements of these kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Lines(HTMLParser):
    """Turns parser events into lines: [text, tags, link characters, container, in an article or main, article's number, the article is named as no main text, the part is]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool, int, bool, bool]] = []  # tag, never, container, in an article or main, article's number, named, part of that name
        self.held: Counter[str] = Counter()  # open elements by tag
        self.containers = 0
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def _state(self) -> tuple[bool, int, bool, int, bool, bool]:
        return self.open[-1][1:] if self.open else (False, 0, False, 0, False, False)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            never, *where = self._state()
            if not never:
                self.lines.append([text, self.tags, self.linked, *where])
            self.tags = self.linked = 0
        self.parts.clear()

    def _shut(self, at: int) -> None:
        """End the open element at this place and all in it."""
        self.held.subtract(x[0] for x in self.open[at:])
        del self.open[at:]

    def _unwanted(self, tag: str, attrs: list, article: bool) -> bool:
        if tag in NEVER:
            return True
        if tag == "header":
            return not article
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
            if name in ("class", "id", "role") and value and not (article and tag in TEXT) and tag not in ("html", "body", "article", "main"):
                words = {w.lower() for w in WORDS.findall(value)}
                if words & (NAMES - OWN if article else NAMES) or not article and words & HEADS:
                    return True
        return False

    @staticmethod
    def _named(attrs: list) -> bool:
        return any(name in ("class", "id", "role") and value and {w.lower() for w in WORDS.findall(value)} & NAMES for name, value in attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._end_line()
            if (ends := CLOSES.get(tag)) or tag in BLOCK and any(x[0] == "p" for x in self.open[-4:]):
                self._close(ends or {"p"})
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                self.parts.append("" if tag == "wbr" else "\n")
            return
        never, container, article, border, named, part = self._state()
        if tag in ("article", "main"):
            article = True
        if not never:
            never = self._unwanted(tag, attrs, article)
        if tag == "article" or tag in CONTAINER and not border:
            self.containers += 1
            container = self.containers
        if tag == "article":
            border, named = container, named or self._named(attrs)
        elif border and not part and tag not in TEXT and self._named(attrs):  # of OWN's names: others never count
            self.containers += 1
            container, part = self.containers, True
        self.held[tag] += 1
        self.open.append((tag, never, container, article, border, named, part))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, kinds: set[str]) -> None:
        """End the innermost open element of these kinds, unless a container lies between."""
        if not any(self.held[k] for k in kinds):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in kinds:
                self._shut(at)
                return
            if self.open[at][0] in CONTAINER or self.open[at][0] in ("ul", "ol", "table", "dl"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        if not self.held[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._shut(at)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.parts.append(data)
        if any(x[0] == "a" for x in self.open[-3:]):
            self.linked += len(data)


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(np.ceil(2 * sigma)))
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-0.5 * (at / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[radius:-radius]
    return np.convolve(values, kernel, "full")[radius:-radius] / weight


def split(values: np.ndarray) -> float:
    """The boundary between two clusters of numbers (Lloyd's algorithm on a line)."""
    low, high = values.min(), values.max()
    for _ in range(20):
        middle = (low + high) / 2
        upper = values >= middle
        if upper.all():
            return float(values.min())
        new = values[~upper].mean(), values[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return float((low + high) / 2)


def main_text(html: str, sigma: float = 1.0, most_linked: float = 0.6, article_weight: float = 2.0) -> str:
    """The main text: lines of the content regions, joined by one space; empty if there is none."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = size / np.maximum(1, [x[1] for x in lines])
    border = np.array([x[5] for x in lines])
    cuts = [0, *(np.flatnonzero(np.diff(border)) + 1).tolist(), len(lines)]
    smoothed = np.concatenate([smooth(ratio[i:j], sigma) for i, j in zip(cuts, cuts[1:], strict=False)])
    level = np.log1p(smoothed)
    named = np.array([x[6] for x in lines])
    # The boundary is that of the text alone: evidence raises lines of an article, it lowers no others.
    part = np.array([x[7] for x in lines])
    upper = level + np.where(np.array([x[4] for x in lines]) & ~named & ~part, np.log(article_weight), 0) >= split(level)
    content = upper & (np.array([x[2] for x in lines]) <= most_linked * size)
    if not content.any() and any(x[4] for x in lines):
        content = upper & np.array([x[4] for x in lines])  # an article made of links
    if size[content & ~named].sum() >= size[content & named].sum():
        content &= ~named
    regions = {x[3] for x, y in zip(lines, content, strict=True) if y}
    return " ".join(x[0] for x in lines if x[3] in regions)


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, in one pass without a shuffle.

    A null or empty page has an empty text; null ids and urls stay null; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> dict:
        found = [main_text(h, sigma) for h in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": found, "n_chars": [len(t) for t in found]}

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(arrow_map(PAGES, each, 256), "page_id long, url string, text string, n_chars long")
