"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events; block tags end a line, and each line
knows its text, its tags and the element it stands in. Its ratio is unlinked
characters a tag, divided by ``MARKED`` for every element round it that a tag name,
class or id marks as boilerplate, so that a mark on a wrapper of the whole page
changes no order. Logarithms of the ratios are smoothed by a Gaussian, and a
two-means threshold tells the content lines.

The content region is the smallest element with 7/10 of the content lines' text. It
grows to its parent as long as what that adds is mostly content, headings, or
little; an article or main element grows only for content outside it. The text is
the region's lines, but for those mostly of links, those of elements that are always
left out, and those of marked elements that hold less than half of the content.
Lines right below the body count only between the first and the last heading or
content line of at least a third of the content lines' median length.

Markup is cut into tags in one pass before the parser sees it, so no input makes the
parser start again: a comment, tag or script that never ends takes the rest of the
page with it, as in browsers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm import words as W

# fixed values: element names, and words in class, id and role that mark boilerplate
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_DROPPED = frozenset("head title script style noscript template menu button select option textarea iframe object svg canvas dialog audio video math".split())
_MARKED_TAGS = frozenset("nav header footer aside form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKS = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments reply replies respond disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget toolbar pagination pager complementary contentinfo search skip".split()
)
_MAIN = frozenset({"article", "main"})
_CLOSED_BY = {"li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
#: Parts of names after which the next part only tells what a page has or lacks.
_STATES = frozenset("has have no not with without".split())
_TAG = re.compile(r"<(?:[!?][^>]*+>|/?+(?P<name>[a-zA-Z][^\s/>]*+)(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+>)")
_SPACE = re.compile(r"\s+")

#: What a mark divides a line's ratio by.
MARKED = 5.0
#: Shares of the content's text: that a region holds, and below which a marked element is boilerplate.
REGION, SPARED = 0.7, 0.5
#: Text that a parent may add without being content, as a share of the region's; and inside an article or main element.
SLACK, MAIN_SLACK = 0.2, 0.5


def _named(value: str) -> bool:
    """Whether a class or id names boilerplate."""
    for name in value.lower().split():
        before = ""
        for part in _NAME_PARTS.split(name):
            if part in _MARKS and before not in _STATES:
                return True
            before = part
    return False


class Lines(HTMLParser):
    """Lines of a page, and its elements in the order of their start tags; element 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.element: list[int] = []
        self.heading: list[bool] = []
        # of each element
        self.parent = [0]
        self.name = [""]
        self.marked = [False]
        self.dropped = [False]
        self.in_main = [False]  # an article or main element, or in one
        self._open = [0]
        self._at: dict[str, list[int]] = {}  # places in _open by name
        self._blocks = [0]  # places in _open of all but inline elements
        self._part: list[str] = []
        self._tag = 0
        self._link = 0
        self._head = False

    def read(self, html: str) -> None:
        at, search = 0, html.find
        while True:
            tag = search("<", at)
            while tag >= 0 and not (html[tag + 1 : tag + 2].isalpha() and html[tag + 1].isascii() or html[tag + 1 : tag + 2] in ("/", "!", "?")):
                tag = search("<", tag + 1)
            if tag < 0:
                self._give(html[at:])
                break
            if tag > at:
                self._give(html[at:tag])
            if html.startswith("<!--", tag):
                end = search("-->", tag + 2)
                at = end + 3
                if end < 0:
                    break
                continue
            if html.startswith("</", tag) and not (html[tag + 2 : tag + 3].isalpha() and html[tag + 2].isascii()):
                end = search(">", tag)
                at = end + 1
                if end < 0:
                    break
                continue
            found = _TAG.match(html, tag)
            if not found:
                break
            at = found.end()
            name = found["name"]
            if not name:
                continue
            self.feed(html[tag:at])
            if self.rawdata:  # a tag that the parser still waits on
                self.rawdata = ""
            if name.lower() in _RAW and html[tag + 1] != "/":
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                self.clear_cdata_mode()
                if not end:
                    break
                at = end.start()
        self._flush()

    def _give(self, data: str) -> None:
        if not self.dropped[self._open[-1]]:
            self.handle_data(self._unescape(data))

    @staticmethod
    def _unescape(data: str) -> str:
        from html import unescape

        return unescape(data) if "&" in data else data

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._part)).strip()
        if text:
            self.text.append(text)
            self.tags.append(max(1, self._tag))
            self.linked.append(self._link)
            self.element.append(self._open[self._blocks[-1]])
            self.heading.append(self._head)
        self._part, self._tag, self._link = [], 0, 0
        self._head = False

    def _pop(self, to: int) -> None:
        while len(self._open) > to:
            self._at[self.name[self._open.pop()]].pop()
        while self._blocks[-1] >= to:
            self._blocks.pop()

    def _block(self) -> str:
        return self.name[self._open[self._blocks[-1]]]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inline = tag in _INLINE
        self._tag += 1
        if inline:
            if tag == "br":
                self._part.append(" ")
            if tag == "a" and self._at.get("a") and self._at["a"][-1] > self._blocks[-1]:
                self._pop(self._at["a"][-1])  # links do not nest
        else:
            count, self._tag = self._tag, self._tag - 1
            self._flush()
            self._tag = count - self._tag if self._tag else 1
            closing = _CLOSED_BY.get(tag, ())
            while len(self._blocks) > 1 and (self._block() == "p" or self._block() in closing):
                self._pop(self._blocks[-1])
        if tag in _VOID:
            return
        outer = self._open[-1]
        dropped = self.dropped[outer] or tag in _DROPPED
        role = next((value for key, value in attrs if key == "role" and value), "").lower()
        main = tag in _MAIN or role == "main"
        marked = tag in _MARKED_TAGS and not (tag == "header" and self.in_main[outer])
        if not dropped and tag not in ("body", "html"):
            for key, value in attrs:
                if key == "hidden" or key == "role" and not _MARKS.isdisjoint(_NAME_PARTS.split(role)):
                    dropped = True
                elif key in ("class", "id") and value and _named(value):
                    marked = True
        self._open.append(len(self.parent))
        self._at.setdefault(tag, []).append(len(self._open) - 1)
        if not inline:
            self._blocks.append(len(self._open) - 1)
            self._head = tag in _HEADINGS
        elif not (marked or dropped):
            # an inline element is no region: its lines are those of the block round it
            self._open[-1] = len(self.parent)
        self.parent.append(outer)
        self.name.append(tag)
        self.marked.append(marked and not dropped)
        self.dropped.append(dropped)
        self.in_main.append(self.in_main[outer] or main and not dropped)

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        inline = tag in _INLINE
        if not inline:
            self._flush()
        self._tag += 1
        at = self._at.get(tag)
        if at and (not inline or at[-1] > self._blocks[-1]):
            self._pop(at[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends no element in html

    def handle_data(self, data: str) -> None:
        self._part.append(data)
        if self._at.get("a"):
            self._link += len(data.strip())


def content_lines(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines are content: smoothed ratios above the midpoint of two clusters."""
    if len(ratios) < 2:
        return np.ones(len(ratios), bool)
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")
    low, high = float(smooth.min()), float(smooth.max())
    for _ in range(20):
        upper = smooth > (low + high) / 2
        if not upper.any() or upper.all():
            break
        now = float(smooth[~upper].mean()), float(smooth[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return smooth >= (low + high) / 2


def _sums(parent: np.ndarray, element: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the lines' values in each element, those inside it included."""
    out = np.bincount(element, weights=values, minlength=len(parent))
    for k in range(len(parent) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by a blank line; empty if there are none."""
    page = Lines()
    page.read(html or "")
    if not page.text:
        return ""
    parent, element = np.array(page.parent), np.array(page.element)
    size = np.array([len(x) for x in page.text], float)
    free = np.maximum(size - page.linked, 0.0)
    unlinked = 2 * np.array(page.linked) <= size
    marks = np.zeros(len(parent), np.int64)
    for k in range(1, len(parent)):
        marks[k] = marks[parent[k]] + page.marked[k]
    usable = ~np.array(page.dropped)[element]
    if not usable.any():
        return ""
    seen = np.flatnonzero(usable)
    content = np.zeros(len(size), bool)
    content[seen] = content_lines(np.log1p(free / page.tags / MARKED ** np.minimum(marks[element], 8))[seen])
    content &= unlinked
    weight = np.where(content, free, 0.0)
    told = _sums(parent, element, weight)
    if not told[0]:
        return ""
    lines = _sums(parent, element, content.astype(float))
    # marked elements without most of the content go with all that is in them
    gone = np.zeros(len(parent), bool)
    for k in range(1, len(parent)):
        gone[k] = gone[parent[k]] or page.marked[k] and (told[k] < SPARED * told[0] or lines[k] < 2)
    usable &= ~gone[element]
    weight = np.where(usable, weight, 0.0)
    told = _sums(parent, element, weight)
    if not told[0]:
        return ""
    region = int(np.flatnonzero(told >= REGION * told[0])[-1])
    heading = np.array(page.heading)
    kept = usable & unlinked
    every = _sums(parent, element, np.where(kept, size, 0.0))
    good = _sums(parent, element, np.where(kept & (content | heading), size, 0.0))
    body = {0, *(k for k, name in enumerate(page.name) if name in ("html", "body"))}
    while region not in body:
        outer = int(parent[region])
        added, fine = every[outer] - every[region], good[outer] - good[region]
        closed = page.name[region] in _MAIN and told[outer] == told[region]
        if closed or outer in body and told[outer] == told[region] and page.in_main[region]:
            break
        if added - fine > max((MAIN_SLACK if page.in_main[outer] else SLACK) * every[region], fine):
            break
        region = outer
    inside = np.zeros(len(parent), bool)
    inside[region] = True
    for k in range(region + 1, len(parent)):
        inside[k] = inside[parent[k]]
    kept &= inside[element]
    if region in body:
        sure = np.flatnonzero(kept & (content & (3 * free >= np.median(free[content & usable])) | heading))
        between = np.zeros(len(size), bool)
        between[sure[0] : sure[-1] + 1] = True
        loose = np.array([k in body or p in body for k, p in enumerate(page.parent)]) & ~np.array(page.in_main)
        kept &= between | ~loose[element]
    return "\n\n".join(page.text[k] for k in np.flatnonzero(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            text = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns one row per input row: page_id, url, text, n_chars (code points). Text
    is empty for null, empty or text-free html. White space inside a block is one
    space. Repeated rows are separate rows with the same text; an empty table gives
    an empty result; null ids and urls stay null; other columns are ignored,
    whatever their names. The whole html is parsed, in time and memory in proportion
    to its length.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return W.over(rows, _extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
