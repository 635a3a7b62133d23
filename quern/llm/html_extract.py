"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's streaming parser feeds events; only the blocks made so far are held. A block is
the text between two block-level tags (or in a table cell); ``br`` and other markup inside a block are
white space or nothing. Elements that by their tag never hold main text are skipped with all they contain:
scripts, styles, navigation, headers and footers of the page, asides, forms. A header inside an article
stays when it holds the title.

What else stays is decided by the text-to-tag ratio (Weninger et al., 2010). A block's ratio is its
characters over its tags (1 at least), characters of links counting for a quarter. The ratios are smoothed
with a Gaussian over neighbouring blocks and multiplied by the block's weight; blocks fall into two clusters
at the threshold ``cut`` times the standard deviation of the smoothed ratios. Weights are what a page says of
its regions:

* names of class, id and role lower it (``UNWANTED``, and ``CLOSING`` for readers' comments, which are prose
  like the article): by the share of a name's words that say so, so that "sidebar" weighs little and
  "related-work" half. Names such as has-sidebar only tell what else is there.
* where a page marks an article (``article``, ``main``), text outside it weighs next to nothing. An article
  that is itself a comment or an advert is none; one inside a lowered region counts where there is no other.

A block of a lowered region stays if its weighted smoothed ratio reaches ``FLOOR`` and it isn't links, so short adverts between
long paragraphs go and a "related-work" section of prose stays. Other blocks of a marked article go only if
they are links (by their own ratio) outside the upper cluster. Where a page marks no article, the content runs
from the first to the last block of the upper cluster that isn't nearly all links, and back to the heading of
the prose that leads to it; of the lower cluster only link blocks are dropped from between.

A skipped element left open can hold the article itself: if no text outside links is left and an article was
skipped, the page is read again and only what is inside articles counts.

Defined results: null or empty html, or no text: empty text. Character references are decoded, white
space inside a block becomes one space, ends are trimmed, blocks are joined by newline in page order. One
result row per input row, also for repeated or null page_ids; an empty table gives an empty result; other
columns are ignored, whatever their names. Broken markup is read as far as the parser reads it; long pages are
read whole; nothing is capped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import parts
from quern.shipping import ship

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SKIP_TAGS = frozenset("script style noscript template head nav aside form footer button select textarea iframe object svg math canvas audio video dialog menu".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that a start tag closes if they are still open (their end tags may be left out).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of a class, id or role whose regions rarely hold main text.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social subscribe newsletter signup login search "
    "complementary contentinfo pagination pager toolbar copyright hidden".split()
)
#: Words of regions of readers' text. It looks like the article's, so no ratio can tell them apart.
CLOSING = frozenset("comment comments disqus respond reply replies".split())
#: Words of a name that say nothing about what is inside.
NEUTRAL = frozenset("area bar block box container content group inner item items list main outer page panel post section site slot the top user wrap wrapper".split())
KEEP_ROOTS = frozenset(["article", "main"])
#: Words that make an article none.
NO_ROOT_WORDS = CLOSING | frozenset("ad ads advert adverts advertisement sponsored promo related recommended".split())
#: A name with one of these tells what a region holds or lacks, not what it is.
ABOUT_WORDS = frozenset("has with no without".split())
#: Weights: of a name all of whose words are unwanted, of one that is half unwanted, of readers' text, of text outside a marked article.
LOW, HALF, LOWEST, OUTSIDE = 1 / 64, 1 / 2, 1 / 1024, 1 / 1024
#: The weighted ratio that a lowered block needs, and the own ratio below which a block is a list of links.
FLOOR, LINK_RATIO, LINK_PART = 10.0, 4.0, 0.25
TOKEN = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A tag that the page ends in; it is no text.
CUT_TAG = re.compile(r"</?[A-Za-z][^<>]*\Z")
LINK_SHARE = 0.8


def name_weight(value: str) -> float:
    """The weight of a class, id or role attribute: the least of its names'. userComments is both one word and two."""
    least = 1.0
    for name in value.split():
        split = TOKEN.findall(CAMEL.sub(" ", name).lower())
        if not ABOUT_WORDS.isdisjoint(split):
            continue
        words = [w for w in split if w not in NEUTRAL]
        joined = TOKEN.findall(name.lower())
        if not CLOSING.isdisjoint(split + joined):
            return LOWEST
        if words and all(w in UNWANTED for w in words) or not UNWANTED.isdisjoint(joined) and len(joined) == 1:
            least = min(least, LOW)
        elif not UNWANTED.isdisjoint(words):
            least = min(least, HALF)
    return least


class Block(NamedTuple):
    text: str
    outside: int  # characters outside links
    tags: int
    root: bool  # inside an article
    before: float  # weight of the regions around the article (or of all regions)
    weight: float  # weight of the regions inside the article
    heading: bool


class Region(NamedTuple):
    tag: str
    skipped: bool
    root: bool
    before: float
    weight: float


class Blocks(HTMLParser):
    """Blocks of a page. inside_only: nothing outside articles is looked at."""

    def __init__(self, inside_only: bool = False):
        super().__init__(convert_charrefs=True)
        self.inside_only, self.swallowed = inside_only, False
        self.blocks: list[Block] = []
        self.open: list[Region] = []
        self.skips = self.roots = self.links = self.tags = self.linked = 0
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._imply_end(CLOSES[tag])
        if tag in BLOCK_TAGS:
            self._flush()
            if tag != "p":
                self._imply_end(("p",), only_last=True)
            elif self.open and self.open[-1].tag == "p":
                self._pop()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID_TAGS:
            return
        weight, hidden = self._weight(tag, attrs)
        skipped = (self.roots > 0 or not self.inside_only or tag in KEEP_ROOTS) and (tag in SKIP_TAGS or (tag == "header" and not self.roots) or hidden)
        root = not skipped and weight == 1 and (tag in KEEP_ROOTS or ("role", "main") in attrs)
        self.swallowed |= root and self.skips > 0
        self.skips += skipped
        before, inner = self._weights()
        if root and not self.roots:
            before, inner = before * inner, 1.0
        self.roots += root
        self.links += tag == "a"
        self.open.append(Region(tag, skipped, root, before, inner * weight))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.open and self.open[-1].tag == tag and tag in ("svg", "math", "path"):
            self._pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK_TAGS:
            self._flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i].root or (self._bounded(i) and tag not in ("body", "html")):
                return  # an end tag without a start doesn't close a region

    def handle_data(self, data):
        if not self.skips:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def _bounded(self, i: int) -> bool:
        """Whether the region is one of its own: skipped, or lowered by its names."""
        around = self.open[i - 1].weight if i else 1.0
        return self.open[i].skipped or (not self.open[i].root and self.open[i].weight < around)

    def _weights(self) -> tuple[float, float]:
        return (self.open[-1].before, self.open[-1].weight) if self.open else (1.0, 1.0)

    def _weight(self, tag: str, attrs) -> tuple[float, bool]:
        """The weight that the names of an element give, and whether it is hidden."""
        least, hidden = 1.0, False
        if tag in ("html", "body"):
            return least, hidden
        for name, value in attrs:
            hidden |= name == "hidden" or (name == "aria-hidden" and value == "true")
            if name in ("class", "id", "role") and value:
                if tag in KEEP_ROOTS:
                    names = [set(TOKEN.findall(CAMEL.sub(" ", n).lower())) | set(TOKEN.findall(n.lower())) for n in value.split()]
                    if any(ABOUT_WORDS.isdisjoint(n) and not NO_ROOT_WORDS.isdisjoint(n) for n in names):
                        least = LOWEST
                elif not (tag in ("header", "h1", "h2", "h3", "hgroup") and self.roots):
                    least = min(least, name_weight(value))
        return least, hidden

    def _imply_end(self, tags: tuple[str, ...], only_last: bool = False) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i].tag
            if name in tags:
                self._flush()
                while len(self.open) > i:
                    self._pop()
                return
            if only_last or name in ("ul", "ol", "dl", "table", "select", "article", "main", "div", "section"):
                return

    def _pop(self) -> None:
        gone = self.open.pop()
        self.skips -= gone.skipped
        self.roots -= gone.root
        self.links -= gone.tag == "a"

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and not self.skips and (self.roots or not self.inside_only):
            heading = any(r.tag in ("h1", "h2", "h3") for r in self.open[-3:])
            self.blocks.append(Block(text, max(len(text) - self.linked, 0), max(self.tags, 1), self.roots > 0, *self._weights(), heading))
        self.text, self.tags, self.linked = [], 0, 0

    def finish(self) -> list[Block]:
        self.rawdata = CUT_TAG.sub("", self.rawdata)
        self.close()
        self._flush()
        return self.blocks


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbours within two sigma, weights renormalised at the ends."""
    r = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(ratios, kernel)[r:-r] / np.convolve(np.ones(len(ratios)), kernel)[r:-r]


def chosen(blocks: list[Block], sigma: float = 1.0, cut: float = 1.0) -> np.ndarray:
    """Which blocks are main text; see the module's text."""
    outside = np.fromiter((b.outside for b in blocks), float, len(blocks))
    size = np.fromiter((len(b.text) for b in blocks), float, len(blocks))
    ratios = (outside + LINK_PART * (size - outside)) / np.fromiter((b.tags for b in blocks), float, len(blocks))
    before, inner = (np.fromiter((getattr(b, k) for b in blocks), float, len(blocks)) for k in ("before", "weight"))
    roots = np.fromiter((b.root for b in blocks), bool, len(blocks))
    # an article in a lowered region (one that was left open, say) counts where there is no other
    marked = roots & (before == 1) if (roots & (before == 1)).any() else roots
    if marked.any():
        weight = np.where(marked, inner, OUTSIDE * inner)
    else:
        weight = before * inner
    smoothed = smooth(ratios, sigma)
    score = smoothed * weight
    prose = outside >= (1 - LINK_SHARE) * size
    full = weight == 1
    upper = score >= min(cut * smoothed.std(), score.max())
    if marked.any():
        keep = prose | upper | (ratios >= LINK_RATIO)
    else:
        core = np.flatnonzero(upper & prose & full)
        if not len(core):
            core = np.flatnonzero(upper)
        first, last = core[0], core[-1]
        while first and prose[first - 1] and full[first - 1]:
            first -= 1
        first = next((i for i in range(first, core[0]) if blocks[i].heading), core[0])
        keep = prose | upper
        keep[:first] = keep[last + 1 :] = False
    return keep & (full | ((score >= FLOOR) & (prose | (ratios >= LINK_RATIO))))


def main_text(html: str | None, sigma: float = 1.0, cut: float = 1.0) -> str:
    """The main text of one page; see the module's text."""
    parser = Blocks()
    parser.feed(html or "")
    blocks = parser.finish()
    if parser.swallowed and not any(b.outside for b in blocks):
        parser = Blocks(inside_only=True)
        parser.feed(html)
        blocks = parser.finish() or blocks
    if not blocks:
        return ""
    return "\n".join(b.text for b, k in zip(blocks, chosen(blocks, sigma, cut), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0, cut: float = 1.0) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""

    ship(pages.sparkSession)
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "html"):
            out = [main_text(h, sigma, cut) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(texts, "page_id long, url string, text string, n_chars long")
