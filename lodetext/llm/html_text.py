"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that end a line of text, have no content, or hold no running text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
SILENT = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe map math menu meter nav noembed noframes noscript object output progress "
    "script search select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class, id and role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner billboard breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies dialog discussion disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification pagination paywall popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription teaser toc toolbar widget".split()
)
NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
CLOSES_P = BLOCK - {"body", "head", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "option", "optgroup", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


#: Elements of the article that are a line of text themselves.
LINES = HEADINGS | {"p", "blockquote", "pre", "q", "b", "i", "em", "strong", "span", "code", "mark"}
NEGATED = frozenset("no not non has have with without hide hidden is show enable enabled disable disabled".split())


def marks(token: str, whole: bool) -> bool:
    """Whether a class, id or role names what isn't the article; whole: only if it is nothing but that word. `no-sidebar` says something of another element."""
    words = [x.lower() for x in NAMES.findall(token)]
    if whole:
        return len(words) == 1 and words[0] in MARKS
    return not MARKS.isdisjoint(words) and words[0] not in NEGATED


def marked(attrs: list[tuple[str, str | None]], tag: str = "div", within: bool = False) -> bool:
    """Whether attributes say that an element isn't part of the article. article, main and single lines of text only by a word of its own; a header within them may hold the title."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value or ""):
            return True
        if name in ("class", "id", "role") and value:
            for token in value.split():
                if marks(token, tag in ("article", "main") or within and tag in LINES) and not (within and "header" in token.lower()):
                    return True
    return False


@dataclass
class Open:
    """An open element: whether it is silent, whether by more than a form, and the block it is or stands in."""

    tag: str
    silent: bool
    hard: bool
    block: int


class Lines(HTMLParser):
    """Turns events into lines: (text, tags since the line before, block, silent). Blocks are numbered in page order and know the one around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[Open] = []
        self.count: Counter[str] = Counter()  # of open elements
        self.kind: list[str] = []  # of each block
        self.around: list[int] = []  # the block around each, -1 for none
        self.hushed: list[bool] = []  # whether each is silent
        self.within: list[bool] = []  # whether each is an article or main or in one
        self.held: list[str] = []
        self.tags = 0

    def end_line(self):
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            last = self.open[-1] if self.open else OUTSIDE
            self.lines.append((text, self.tags, last.block, last.silent))
            self.tags = 0

    def pop_to(self, i: int):
        self.end_line()
        self.count.subtract(x.tag for x in self.open[i:])
        del self.open[i:]

    def implied(self, tag: str):
        """End tags that a start tag implies."""
        if tag in CLOSES_P and self.count["p"]:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == "p":
                    self.pop_to(i)
                    break
                if self.open[i].tag in BLOCK:
                    break
        if tag in SIBLINGS and any(self.count[t] for t in SIBLINGS[tag]):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in SIBLINGS[tag]:
                    self.pop_to(i)
                    break
                if self.open[i].tag in LISTS[tag]:
                    break
        if tag in ("main", "article", "body") and self.count["head"] + self.count["nav"] + self.count["title"] > 0:  # none stands in these; they were left open
            self.pop_to(next(i for i, x in enumerate(self.open) if x.tag in ("head", "nav", "title")))

    def handle_starttag(self, tag, attrs):
        self.implied(tag)
        if tag == "br":
            self.held.append(" ")
        elif tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        last = self.open[-1] if self.open else OUTSIDE
        silent, block = last.silent, last.block
        within = block >= 0 and self.within[block]
        if tag in ("article", "main") and silent and not last.hard:
            silent = False  # a form around the whole page
        role = dict(attrs).get("role") or ""
        title = within and tag in HEADINGS and last.tag == "header"
        silent = silent and not title or tag in SILENT or tag == "header" or (tag not in ("html", "body") and marked(attrs, tag, within))
        if tag in BLOCK:
            self.kind.append("main" if role == "main" else tag)
            self.around.append(block)
            self.hushed.append(silent)
            self.within.append(within or self.kind[-1] in ("article", "main"))
            block = len(self.kind) - 1
        self.open.append(Open(tag, silent, last.hard or silent and tag != "form", block))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "g", "use", "rect", "circle"):  # elsewhere HTML ignores the slash
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                if tag in BLOCK:
                    self.pop_to(i)
                else:
                    self.drop(i)
                break
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                break

    def drop(self, i: int):
        """Ends an inline element, maybe below others that stay open."""
        gone = self.open.pop(i)
        self.count[gone.tag] -= 1
        if gone.silent:  # what it made silent speaks again
            for k in range(i, len(self.open)):
                now = self.open[k]
                now.silent = now.tag in SILENT or bool(k and self.open[k - 1].silent)
                if now.tag in BLOCK:
                    self.hushed[now.block] = now.silent

    def handle_data(self, data):
        last = self.open[-1] if self.open else OUTSIDE
        if last.silent and not (last.block >= 0 and self.hushed[last.block]):
            return  # a silent element amid a line that isn't
        self.held.append(data)


OUTSIDE = Open("", False, False, -1)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Ratios under a Gaussian kernel; at the ends by the weights that fall on lines."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    """The article's blocks, joined by line feeds; '' for none.

    Lines of text get the ratio of characters to tags, 0 in silent elements. Smoothed ratios at or above their standard deviation are the content
    cluster. Its regions are the outermost article elements, else main elements, that hold at least `share` of the characters the richest holds of the cluster,
    else the innermost element with nearly all of the cluster, else the page. Every line in a region that isn't silent is text, however short.
    Work and memory grow with the page, whatever its depth.
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines, kind, around = parser.lines, parser.kind, parser.around
    if not lines:
        return ""
    ratios = np.array([0.0 if silent else len(text) / max(1, tags) for text, tags, _, silent in lines])
    even = smoothed(ratios, sigma)
    content = [i for i in range(len(lines)) if even[i] >= even.std() and not lines[i][3]] or [i for i in range(len(lines)) if not lines[i][3]]
    mass = [0] * len(kind)
    for i in content:
        if lines[i][2] >= 0:
            mass[lines[i][2]] += len(lines[i][0])
    for b in range(len(kind) - 1, -1, -1):  # a block comes after the one around it
        if around[b] >= 0:
            mass[around[b]] += mass[b]
    total = sum(len(lines[i][0]) for i in content)
    regions: set[int] = set()
    for name in ("article", "main"):
        inside, outer = [False] * len(kind), []
        for b, k in enumerate(kind):
            inside[b] = k == name or around[b] >= 0 and inside[around[b]]
            if k == name and mass[b] and not (around[b] >= 0 and inside[around[b]]):
                outer.append(b)
        if outer:
            most = max(mass[b] for b in outer)
            regions = {b for b in outer if mass[b] >= share * most}
            break
    if not regions and total:
        wide = [b for b, m in enumerate(mass) if m >= 0.9 * total and kind[b] not in ("p", "li", "td", "blockquote", "pre")]
        regions = {max(wide)} if wide else set()
    inside = [False] * len(kind)
    for b in range(len(kind)):
        inside[b] = b in regions or around[b] >= 0 and inside[around[b]]
    return "\n".join(text for text, _, b, silent in lines if not silent and (not regions or b >= 0 and inside[b]))


def text_column(html: str, sigma: float = 1.0) -> Column:
    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x, sigma) for x in pages], dtype=object)

    return extracted(F.col(html))


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text and n_chars (code points). Null, empty and textless html give ''; rows are independent of each other, repeated ones are kept, other columns are ignored."""
    return pages.select("page_id", "url", text_column("html", sigma).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
