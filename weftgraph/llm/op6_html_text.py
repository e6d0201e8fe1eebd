"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's streaming parser gives events; block elements cut them
into lines. Each line has a text-to-tag ratio, its characters over its tags. The
ratios are smoothed with a Gaussian over neighbouring lines; lines above the
threshold (the mean less half a standard deviation, of lines that nothing marks
as boilerplate) form clusters. What the clusters hold decides the rest:

* the element that holds the content is the outermost article, else main
  element, with half of the clusters' text; else the deepest other container with
  ``SHARE`` of it, and containers around that as long as they add no lists of links;
* inside it, the clusters' lines are kept and so are shorter lines beside and
  between them (headings, items, cells), but not runs of two or more lines below
  the threshold that are mostly links; outside an article or main element no
  line that is mostly links is kept;
* an element that only its class, id or role names as a menu, advert, notice or
  comment goes, unless the clusters have most of their text in it; a single
  paragraph or inline element with a weak name (``WEAK``) goes only if it is in
  no cluster.

Elements that are no text by their tag (menus, footers, asides, forms, scripts,
styles, ...; a page's header outside the article) or hidden always go.

Work and memory grow in proportion to the page: lines know their innermost
element, elements their parent.

Defined cases: null html counts as empty; a page without main text gives ''. Each
input row gives one output row. Malformed markup is read as the parser reads it.
Columns other than those named are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches

SIGMA = 1.0
SHARE = 0.9
ROWS = 256

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas select option datalist audio video textarea button title".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section table tbody td tr center html".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist respond disqus replies related recommended share sharing social newsletter subscribe subscription signup login widget pagination pager toolbar skip hidden complementary contentinfo".split()
)
WEAK = frozenset("promo promotion banner alert overlay modal respond replies related recommended share sharing social newsletter subscribe subscription signup login widget toolbar skip masthead".split())
#: Words that make a name one of something else: no-sidebar, with-comments.
TURNING = frozenset("no not non without has with".split())
HEADER_NAMES = frozenset({"header", "topbar"})
#: What an opening tag closes, if it is the innermost open element of those.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PARAGRAPH_ENDS = BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
WORDS = re.compile(r"[a-z0-9]+")


class Lines(HTMLParser):
    """Collects (text, tags, characters in links, dropped, element) of each line, and the tree of the elements that matter: containers and those with telling names."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, unseen, dropped, the innermost element
        self.count: dict[str, int] = {}
        # By element, in the order in which they open; 0 is the page.
        self.kind, self.parent, self.named = ["html"], [0], [""]
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.unseen = self.dropped = 0

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.dropped > 0, self.open[-1][3] if self.open else 0))
            self.tags = 0
        self.text, self.linked = [], 0

    def _has(self, *tags: str) -> bool:
        return any(self.count.get(t) for t in tags)

    def _dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in BOILERPLATE or tag == "header" and not self._has("article", "main"):
            return True
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower() for name, value in attrs)

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """The telling word of a class, id or role: the first or last word of a whole name."""
        if tag not in ("body", "html", "article", "main"):
            for name, value in attrs:
                for whole in (value or "").lower().split() if name in ("class", "id", "role") else ():
                    words = WORDS.findall(whole)
                    if words and not TURNING & set(words):
                        for word in (words[-1], words[0]):
                            if word in NAMES or word in HEADER_NAMES and not self._has("article", "main"):
                                return word
        return ""

    def _pop(self, at: int) -> None:
        gone = self.open[at:]
        if any(x[0] in BLOCKS or x[2] or self._starts(x[3], y) for x, y in zip(gone, [self.open[at - 1][3] if at else 0, *(x[3] for x in gone)], strict=False)):
            self.cut()
        for tag, unseen, dropped, _ in gone:
            self.count[tag] -= 1
            self.unseen -= unseen
            self.dropped -= dropped
        del self.open[at:]

    def _starts(self, element: int, around: int) -> bool:
        return element != around and bool(self.named[element])

    def _close(self, wanted: str, limits: frozenset[str] | tuple[str, ...]) -> None:
        """Pops up to the innermost open element of a tag, if none of the limits is inside it."""
        if self._has(wanted):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == wanted:
                    self._pop(at)
                    return
                if self.open[at][0] in limits:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in PARAGRAPH_ENDS:
            self._close("p", CONTAINERS)
        for closed in CLOSES.get(tag, ()):
            self._close(closed, ("ul", "ol", "dl", "table", "article", "body", "div"))
        if tag == "body":
            self._close("head", ())
        if tag in BLOCKS:
            self.cut()
        if tag in VOID:
            return
        dropped, named = self._dropped(tag, attrs), self._named(tag, attrs)
        if dropped or named:
            self.cut()
        element = self.open[-1][3] if self.open else 0
        if tag in CONTAINERS or named:
            self.kind.append(tag)
            self.parent.append(element)
            self.named.append(named)
            element = len(self.kind) - 1
        self.open.append((tag, tag in UNSEEN, dropped, element))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.unseen += tag in UNSEEN
        self.dropped += dropped

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self._has(tag):
            self._close(tag, () if tag in BLOCKS else ("article", "body", "main", "table"))
        elif tag in BLOCKS:
            self.cut()

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            if self.count.get("a"):
                self.linked += len(data)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbours; at the ends over those that are there."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    over = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return over(values) / over(np.ones(len(values)))


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    lines, kind, parent = parser.lines, parser.kind, np.array(parser.parent)
    if not lines:
        return ""
    of = np.array([x[4] for x in lines])
    marked = np.zeros(len(kind), bool)
    for n in range(1, len(kind)):  # parents come first
        marked[n] = marked[parent[n]] or bool(parser.named[n])
    seen = ~np.array([x[3] for x in lines], dtype=bool)
    good = seen & ~marked[of] if (seen & ~marked[of]).any() else seen
    if not good.any():
        return ""
    size = np.array([len(x[0]) for x in lines], dtype=float)
    links = np.array([x[2] for x in lines]) * 2 >= size
    plain = size / np.array([max(1, x[1]) for x in lines])
    ratio = smoothed(plain)
    least = ratio[good].mean() - ratio[good].std() / 2
    # A line that is mostly links is in a cluster only by its own ratio, not by its neighbours'.
    chosen = seen & (ratio >= least) & (~links | (plain >= least))
    weight = summed(np.bincount(of[chosen], size[chosen], minlength=len(kind)), parent)
    total = weight[0]
    # Names alone drop no element in which the clusters have most of their text, and no paragraph of a cluster for a weak one.
    within = summed(np.bincount(of[chosen], minlength=len(kind)).astype(float), parent)
    bad = np.zeros(len(kind), bool)
    for n in range(1, len(kind)):
        word = parser.named[n]
        spared = weight[n] * 2 > total or word in WEAK and kind[n] not in CONTAINERS | {"ul", "ol", "dl"} and within[n] > 0
        bad[n] = bad[parent[n]] or bool(word) and not spared
    good = seen & ~bad[of]
    chosen &= good
    weight = summed(np.bincount(of[chosen], size[chosen], minlength=len(kind)), parent)
    total = weight[0]
    last = np.arange(len(kind)) + summed(np.ones(len(kind)), parent).astype(int)  # elements inside n are n up to, not including, last[n]
    inside = lambda n: (of >= n) & (of < last[n])
    for name in ("article", "main"):
        named = [n for n in range(len(kind)) if kind[n] == name and weight[n] * 2 >= total]
        if named:
            kept = good & inside(named[0])
            # Of lines that are mostly links and in no cluster, a run of two or more is a list of links.
            low = kept & links & ~chosen
            beside = np.zeros(len(lines), bool)
            beside[1:], beside[:-1] = low[:-1], beside[:-1] | low[1:]
            return " ".join(x[0] for x, ok in zip(lines, kept & ~(low & beside), strict=True) if ok)
    top = int(np.flatnonzero(weight >= SHARE * total)[-1]) if total else 0
    # Outwards, while what the next container adds is text too: a heading above the text's own element, say.
    while top and kind[outer := int(parent[top])] not in ("body", "html") and not (good & links & inside(outer)).any():
        top = outer
    return " ".join(x[0] for x, ok in zip(lines, good & ~links & inside(top), strict=True) if ok)


def summed(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Of each element, with all elements inside it; an element's number is higher than its parent's."""
    total = own.tolist()
    for n in range(len(total) - 1, 0, -1):
        total[parent[n]] += total[n]
    return np.array(total)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text) of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made = pa.array([main_text(h) for h in batch.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], [*keep, "text"])

    bounded_batches(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html).alias("html")).mapInArrow(work, f"{kinds}, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
