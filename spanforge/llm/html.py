"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, clustering.

The standard-library parser streams events over the whole page. Block elements cut the page
into lines; each line knows its text, the number of tags seen since the line before and the
region it lies in. Regions are nested: article, main, section, div, td, body, and every element
that its tag, role or a whole word of its class or id marks as page furniture.

The logarithms of the text-to-tag ratios are smoothed with a Gaussian kernel along the page;
marked regions weigh a quarter, and so does what lies outside the articles of a page that has some. A two-means threshold on these scores splits the lines into
content and the rest; a heading goes with the line after it. A region gains the characters of
its content lines and loses those of its other lines, and the unmarked region that gains most
is the main text (the outer one of two alike). If it lies in an article or main element, that whole element is meant,
with unmarked ones beside it. All lines of what is selected are kept, however short, but for marked
regions within it that hold less than half of its gain.

Names never mark html, body, main and article, and inside an article those of its surroundings
count no more, but for names of reader comments. The header of an article is part of it.

Odd pages: null or empty html, or a page of furniture only, gives an empty text; unclosed
elements end with their parent; declarations the parser knows nothing of are skipped as
comments; bytes that are not UTF-8 become U+FFFD; repeated rows give repeated results. Further columns are passed over.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, raw

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never text of the page.
SILENT = frozenset("button canvas head iframe noscript object script select style svg template textarea title".split())
FURNITURE = frozenset("aside dialog footer form header menu nav search".split())
REGION = frozenset("article main section div td body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# fixed values: words of class, id and role that name page furniture
NAMES = frozenset(
    "ad ads adbox advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal navbar nav navigation navigationbar newsletter notice notices outbrain pager pagination "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skyscraper social sponsor "
    "sponsored subscribe subscription taboola toolbar topbar widget widgets complementary contentinfo alert dialog".split()
)
DISCUSSION = frozenset("comment comments disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WEIGHT = 0.25


class Region:
    def __init__(self, parent, tag, marked, weight):
        self.parent, self.tag, self.marked, self.weight = parent, tag, marked, weight
        self.gain = self.n = 0
        self.chosen = self.aside = False


class PageEvents(HTMLParser):
    """Collects the regions, parents first, and the lines as (text, tags, region, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.regions = [Region(None, "body", False, 1.0)]
        self.stack = []  # (tag, region or None for silent elements, in article, marked by name above it, in heading)
        self.lines = []
        self.parts, self.tags = [], 0

    def state(self):
        return self.stack[-1][1:] if self.stack else (self.regions[0], False, False, False)

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                region, _, _, heading = self.state()
                if region is not None:
                    self.lines.append((text, self.tags, region, heading))
                self.tags = 0
            self.parts = []

    def close_to(self, depth):
        if any(tag in BLOCK or tag in SILENT for tag, *_ in self.stack[depth:]):
            self.flush()
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
            return
        if tag in BLOCK or tag in SILENT:
            for depth in range(len(self.stack) - 1, -1, -1):  # what this element closes implicitly
                open_tag = self.stack[depth][0]
                if (open_tag == "p" and tag in BLOCK) or open_tag in CLOSES.get(tag, ()):
                    self.close_to(depth)
                    break
                if open_tag in BLOCK and open_tag not in ("thead", "tbody", "tfoot"):
                    break
            self.flush()
        if tag in VOID:
            return
        region, article, named, heading = self.state()
        if region is not None:
            words, hidden = set(), False
            for name, value in attrs:
                hidden = hidden or name == "hidden" or (name == "aria-hidden" and value == "true")
                if name in ("class", "id", "role") and value:
                    words.update(value.lower().split())
            if tag in SILENT or hidden:
                region = None
            else:
                region, named = self.enter(tag, words, region, article, named)
        self.stack.append((tag, region, article or tag in ("article", "main"), named, heading or tag in HEADINGS))

    def enter(self, tag, words, region, article, named):
        """(region, named) inside an element of these names; named tells for which names a mark stands."""
        talk = not DISCUSSION.isdisjoint(words) and not (tag == "article" and not article)
        own = talk or (tag not in ("html", "body", "main", "article") and not NAMES.isdisjoint(words))
        marked = own or (tag in FURNITURE and not (tag == "header" and article))
        weight = region.weight
        if tag == "article" and named == "layout":  # names around an article say nothing of it
            weight, named = 1.0, False
        if marked:
            weight, named = WEIGHT, "talk" if talk or named == "talk" else "layout" if own and not (tag in FURNITURE) else "tag"
        if marked or tag in REGION:
            region = Region(region, tag, marked, weight)
            self.regions.append(region)
        return region, named

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "p" and not any(t == "p" for t, *_ in self.stack):
            self.flush()
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.close_to(depth)
                return

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.parts.append(data)

    def parse_html_declaration(self, i):
        if self.rawdata[i : i + 3] == "<![":
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def two_means(values: list[float]) -> float:
    """The threshold midway between the centres of two clusters on the line."""
    low, high = min(values), max(values)
    while low < high:
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def line_scores(lines: list, sigma: float) -> list[float]:
    """Smoothed log ratios of text to tags, weighed by region."""
    ratios = smooth([math.log1p(len(text) / max(1, tags)) for text, tags, _, _ in lines], sigma)
    return [ratio * (WEIGHT if region.aside else region.weight) for ratio, (_, _, region, _) in zip(ratios, lines)]


def main_text(html: str, sigma: float = 1.0) -> str:
    parser = PageEvents()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, regions = parser.lines, parser.regions
    if any(region.tag == "article" and region.weight == 1 for region in regions):
        for region in regions:  # what is in no article weighs less
            region.aside = not (region.tag == "article" or (region.parent is not None and not region.parent.aside))
    if not lines or all(region.weight < 1 for _, _, region, _ in lines):
        return ""
    scores = line_scores(lines, sigma)
    cut = two_means(scores)
    content = [score >= cut for score in scores]
    for i in range(len(lines) - 2, -1, -1):  # a heading goes with what it heads
        if lines[i][3] and lines[i][2].weight == lines[i + 1][2].weight:
            content[i] = content[i] or content[i + 1]
    for (text, _, region, _), good in zip(lines, content):
        region.gain += len(text) if good else -len(text)
        region.n += 1
    for region in reversed(regions[1:]):  # children come after their parents
        region.parent.gain += region.gain
        region.parent.n += region.n
    best = max((r for r in regions if r.n and r.weight == 1), key=lambda r: r.gain)  # the first, outer one of ties
    chosen = [best]
    around = best
    while around is not None:
        if around.tag in ("article", "main"):
            chosen = [r for r in regions if r is around or (r.tag == around.tag and r.parent is around.parent and r.weight == 1)]
        around = around.parent
    for region in chosen:
        region.chosen = True
    for region in regions:  # what lies in them, without the furniture there
        inside = region.parent is not None and region.parent.chosen
        region.chosen = region.chosen or (inside and not (region.marked and 2 * region.gain <= best.gain))
    return "\n\n".join(text for text, _, region, _ in lines if region.chosen)


def extract_text(pages: DataFrame, *, sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""

    def run(batches):
        for part in chunks(batches, "html"):
            texts = [main_text(h.decode("utf-8", "replace"), sigma) if h else "" for h in raw(part.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
