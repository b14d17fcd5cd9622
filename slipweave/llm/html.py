"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one per block;
a line's text-to-tag ratio is its characters over its tags, taken as a logarithm
so that a long block does not hide short ones. The ratios are smoothed with a
Gaussian along the page, and two thresholds cluster the lines: a line that
reaches one standard deviation of the smoothed ratios, itself and smoothed, is a
seed, and a region is a run of lines whose smoothed ratio reaches a part (LOW) of
it and that holds a seed. The smoothing also lifts what stands next to a region, so
lines at a region's ends stay only if they are seeds or stand in a container of
its seeds.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are known by tag, role, or a word of the class or id. Their lines
have the ratio zero, which parts regions, and never get into the text. A form, or
a part marked by a layout word, that holds nearly all text of a page (WRAPS) is
the frame of the article and not what the mark says: it is looked through.

Defined cases: null and empty html give an empty text; unclosed and stray tags
are tolerated; character references are decoded, also without a semicolon where
browsers do; pages nested as deep as they are long take memory and time in
proportion to their length; equal rows give equal results; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the page parts that are not main text, and of blocks.
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe svg math button select option textarea dialog menu head title object canvas audio video fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe signup popup modal overlay sidebar side widget widgets related recommended menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer comment comments commentlist respond reply replies disqus share sharing social toolbar pagination pager login search skip".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary center hgroup".split()
) | SKIPPED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset(("article", "main"))
WRAPPERS = frozenset(("html", "body", *REGIONS))
#: Blocks that may stand in a head; any other one ends it.
HEAD = frozenset("title style script noscript template".split())
#: Marks of layout, which a page's frame may carry, too.
LAYOUT = frozenset("sidebar side widget widgets banner header masthead login search modal overlay toolbar skip".split())
#: Blocks that hold text and no blocks: their container is the element around them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption summary figcaption pre".split())
#: Width of the smoothing in lines, the lower threshold as a part of the upper one, the share of text that makes a frame.
SIGMA, LOW, WRAPS = 1.0, 1 / 4, 0.8
KEPT, FRAME, GONE = range(3)

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# An open tag of the same family ends these.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _kind(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """What an element is by its tag and marks: GONE, or FRAME if it may be the page's."""
    if tag in SKIPPED and tag not in ("form", "fieldset"):
        return GONE
    found = FRAME if tag in SKIPPED else KEPT
    for name, value in attrs:
        if not value:
            continue
        if name == "role" and (roles := ROLES & set(value.lower().split())):
            found = max(found, FRAME if roles <= {"form", "search"} else GONE)
        elif name in ("class", "id"):
            words = {w.lower() for w in _WORDS.findall(value)}
            if tag in WRAPPERS:
                if tag in REGIONS and words & {"comment", "comments", "reply"}:
                    return GONE
            elif (marks := words & MARKS) and not words & {"has", "no", "with", "without"}:
                found = max(found, FRAME if marks <= LAYOUT else GONE)
    return found


class Lines(HTMLParser):
    """Collects the blocks of a page as lines, and the elements they stand in.

    Elements are numbered as they open and hold the number of the element around them
    and of the innermost FRAME, so a line needs one number and no path."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.frame, self.gone = ["html"], [-1], [-1], [False]
        self.start, self.end = [0], [None]  # lines of each element
        self.open, self.counts = [0], Counter()
        self.tags = 0
        self.data: list[str] = []
        self.text: list[str] = []
        self.ratio: list[float] = []
        self.element: list[int] = []

    def _flush(self) -> None:
        gone = self.gone[self.open[-1]]
        text = "" if gone else " ".join("".join(self.data).split())
        if text or gone and not all(map(str.isspace, self.data)):
            self.text.append(text)
            self.ratio.append(math.log1p(len(text) / max(1, self.tags)))
            self.element.append(self.open[-1])
            self.tags = 0
        self.data = []

    def _pop(self, at: int) -> None:
        for e in self.open[at:]:
            self.end[e] = len(self.text)
            self.counts[self.tag[e]] -= 1
        del self.open[at:]

    def _top(self) -> str:
        return self.tag[self.open[-1]] if len(self.open) > 1 else ""

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.data.append(" ")
        if tag not in BLOCKS:
            return
        self._flush()
        if tag in VOID:
            return
        if tag not in HEAD and self._top() == "head":  # its end tag may be left out
            self._pop(len(self.open) - 1)
        if self._top() in _CLOSES.get(tag, {"p"}):  # any block ends an open paragraph
            self._pop(len(self.open) - 1)
        kind, around = _kind(tag, attrs), self.open[-1]
        self.open.append(len(self.tag))
        self.frame.append(len(self.tag) if kind == FRAME else self.frame[around])
        self.gone.append(kind == GONE or self.gone[around])
        self.tag.append(tag)
        self.parent.append(around)
        self.start.append(len(self.text))
        self.end.append(None)
        self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED and self._top() == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in BLOCKS:
            return
        self._flush()
        if self.counts[tag]:
            at = len(self.open) - 1
            while self.tag[self.open[at]] != tag:
                at -= 1
            self._pop(at)

    def handle_data(self, data):
        self.data.append(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def finish(self) -> None:
        self.close()
        self._flush()
        self._pop(0)

    def removed(self) -> np.ndarray:
        """Lines of parts that are not main text, once the page's frame is looked through."""
        chars = [0] * len(self.tag)
        total = 0
        for text, e in zip(self.text, self.element):
            if not self.gone[e]:
                total += len(text)
                if self.frame[e] >= 0:
                    chars[self.frame[e]] += len(text)
        for e in range(len(self.tag) - 1, 0, -1):  # inner frames add to the ones around them
            if chars[e] and (outer := self.frame[self.parent[e]]) >= 0:
                chars[outer] += chars[e]
        hidden = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            mine = self.frame[e] == e and chars[e] < WRAPS * total
            hidden[e] = mine or hidden[self.parent[e]]
        return np.array([self.gone[e] or hidden[e] for e in self.element], bool)

    def containers(self) -> np.ndarray:
        """The element around each line's own block."""
        return np.array([self.parent[e] if self.tag[e] in LEAVES else e for e in self.element])


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over a window of three deviations; edges use what is there."""
    r = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[r:-r] / np.convolve(np.ones(len(values)), kernel)[r:-r]


def regions(ratio: np.ndarray, removed: np.ndarray, sigma: float = SIGMA, low: float = LOW) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(seeds, runs): a run [i, j) is a region; from the ratios alone."""
    own = np.where(removed, 0.0, ratio)
    smoothed = smooth(own, sigma)
    threshold = min(smoothed.std(), smoothed[own.argmax()], own.max())
    seeds = ~removed & (smoothed >= threshold) & (own >= threshold)
    inside = np.r_[False, smoothed >= low * threshold, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).tolist()
    return seeds, [(i, j) for i, j in edges if seeds[i:j].any()]


def extract(html: str | None, sigma: float = SIGMA) -> str:
    """Blocks of the main text joined by line ends."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    removed = page.removed()
    if removed.all():
        return ""
    around = page.containers()
    seeds, runs = regions(np.array(page.ratio), removed, sigma)
    out = []
    for i, j in runs:
        homes = {c for c in around[i:j][seeds[i:j]].tolist()}
        inner = [c for c in homes if page.tag[c] not in ("html", "body")]
        first, last = min((page.start[c] for c in inner), default=0), max((page.end[c] for c in inner), default=0)

        def belongs(k: int) -> bool:
            return not removed[k] and bool(seeds[k] or around[k] in homes or first <= k < last)

        while not belongs(i):
            i += 1
        while not belongs(j - 1):
            j -= 1
        out += [page.text[k] for k in range(i, j) if not removed[k]]
    return "\n".join(out)


def main_text(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [extract(h.as_py(), sigma) for h in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
