"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page that has text. What stands in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments is stripped with it and leaves an empty line (inside an
article nothing); the bounds of <article> and <main>, and of parts inside them whose class or id is doubtful (a word that an article's own sections
bear as well), leave WINDOW of them. A line weighs its characters outside of links, inside <article> and <main> ARTICLE times as much, links
included. The weights are summed over sliding windows of WINDOW lines. Text surges
where a sum passes SHARE of the page's largest sum, and dives where the sums fall to nothing, that is, in WINDOW lines without
text of their own; what stands between the dives around a surge is kept, from the first line with weight to the last, with the rest of its article.
So the sums decide which parts of a page without <main> are its text, and which doubtful parts of an article belong to it.

Defined results: a null or empty page has the empty text; a page without text as well; a null page_id or url
passes through; repeated rows come out as often as they went in; extra columns are not read; an unclosed element ends with the
element around it, a tag or comment cut off at the end of the page is dropped; equal sums are treated alike; pages of any
length are read whole, in time proportional to their length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.llm.keys import column

#: Lines in a window; the part of the largest sum from which text surges; weight of a character inside the article.
WINDOW, SHARE, ARTICLE = 3, 0.2, 8

#: Elements that are no markup inside, that hold no text of an article, that name it, that break lines, that stand without an end, that end one of their kind.
RAW = "script|style|textarea|title"
ASIDE = frozenset("nav footer aside form dialog menu select button noscript template svg iframe object audio video".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIBLING = frozenset("li dt dd tr td th option p".split())
LIST = frozenset("ul ol dl menu table tbody thead tfoot select body div section article main".split())
#: Elements whose class, id or role may mark them, and the words that mark a part of the page which isn't its article; of these the last ones only outside of it.
CONTAINERS = frozenset("address aside blockquote center details dialog div dl dd dt fieldset figure footer form header li main article menu nav ol p section table tbody td tr ul".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers comment comments reply replies disqus discussion "
    "social share sharing related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget widgets complementary contentinfo".split()
)
OUTSIDE = frozenset("header masthead".split())
#: Words of these that also name parts of an article: inside one the window sums decide on such a part.
DOUBTFUL = frozenset("ad ads alert banner banners consent discussion menu menus navigation notice notices overlay popup promotion related replies reply search sharing social subscription widget widgets".split())
#: Of those the ones that, as a whole name, say advert, notice or box of further pages; only a part of a longer name (related-work) leaves it open.
BOXES = frozenset("ad ads notice notices related".split())
TAG = re.compile(r"(?i)<(/?)([a-z][^\s/>]*)")
TOKEN = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<({RAW})\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][^\s/>]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/a-z][^>]*(?:>|\Z)")
ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def marks(attributes: str) -> tuple[set[str], set[str]]:
    """The names in class, id and role, and their words."""
    names = {x for m in ATTRIBUTE.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()}
    return names, {w for x in names for w in re.split("[^a-z0-9]+", x)}


class Page:
    """The lines of a page: text, its characters without blanks and those of them outside of links, where it stands (0: elsewhere, 1: in an article, 2: in the
    main part), whether in a doubtful part of it, the number of its outermost article. Empty lines are gaps between parts."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, int, int, bool, int]] = []
        counts = Counter((m[2].lower(), m[1]) for m in TAG.finditer(html))
        self.left_open = {name for name, end in counts if not end and counts[name, ""] > counts[name, "/"]}
        self.doubts: list[int] = []  # how many elements were open at each doubtful part
        self.article = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.open: list[str] = []  # elements that are open
        self.skip = 0  # how many were open where what is skipped began, and one more; 0: nothing is skipped
        self.articles: list[int] = []  # how many were open at each article
        self.link = False
        at = 0
        for m in TOKEN.finditer(html):
            self.put(html[at : m.start()])
            at = m.end()
            if m[3] is not None:
                (self.end if m[2] else self.begin)(m[3].lower(), m[4])
        self.put(html[at:])
        self.flush()

    def put(self, text: str) -> None:
        if text and not self.skip:
            self.parts.append(text)
            if self.link:
                self.linked.append(text)

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            solid = lambda x: len("".join(unescape("".join(x)).split()))
            place = 2 if "main" in self.open else 1 if self.articles else 0
            self.lines.append((text, solid(self.parts), solid(self.parts) - solid(self.linked), place, bool(self.doubts), self.article))
        self.parts, self.linked = [], []

    def gap(self, lines: int) -> None:
        self.flush()
        self.lines += [("", 0, 0, 0, False, 0)] * lines

    def cut(self, size: int) -> None:
        """Closes elements until `size` are open."""
        if self.doubts and self.doubts[-1] >= size:
            self.gap(WINDOW)
            while self.doubts and self.doubts[-1] >= size:
                self.doubts.pop()
        del self.open[size:]
        if self.skip > size:
            self.skip = 0
        while self.articles and self.articles[-1] >= size:
            self.gap(WINDOW)
            self.articles.pop()

    def begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.put(" ")
        if name == "a":
            self.link = True
        if name in BLOCK:
            if not self.skip:
                self.flush()
            self.link = False
            if self.open and self.open[-1] == "p":
                self.cut(len(self.open) - 1)
        if name in SIBLING:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] == name:
                    self.cut(k)
                if k >= len(self.open) or self.open[k] in LIST:
                    break
        if name in VOID or attributes.endswith("/"):
            return
        if name in BLOCK or name in ASIDE:
            self.open.append(name)
        if self.skip:
            around = self.open[self.skip - 1]
            if name in MAIN and around not in MAIN and around in self.left_open:  # an article never stands inside what was left open
                self.open[self.skip - 1 :] = [name]
                self.skip = 0
            else:
                return
        names, words = marks(attributes) if name in CONTAINERS else (set(), set())
        if self.articles and name not in ASIDE and words & MARKS and words & MARKS <= DOUBTFUL and not names & BOXES:
            if not self.doubts:
                self.gap(WINDOW)
            self.doubts.append(len(self.open) - 1)
            words = set()
        if name in ASIDE or name == "header" and not self.articles or words & MARKS or words & OUTSIDE and not self.articles and name not in MAIN:
            self.skip = len(self.open)
            if not self.articles and name in BLOCK:
                self.gap(1)
        elif name in MAIN:
            self.gap(WINDOW)
            self.article += not self.articles
            self.articles.append(len(self.open) - 1)

    def end(self, name: str, _: str) -> None:
        if name == "a":
            self.link = False
        if name in BLOCK or name in ASIDE:
            if name in BLOCK:
                if not self.skip:
                    self.flush()
                self.link = False
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] == name:
                    self.cut(k)
                    break


def kept_lines(weights: list[int]) -> list[tuple[int, int]]:
    """First and last line of each part that is kept."""
    if not any(weights):
        return []
    w = np.array(weights, np.int64)
    sums = np.convolve(w, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of each line and those after it
    heavy = np.flatnonzero(w)
    part = np.append(0, np.cumsum(np.diff(heavy) > WINDOW))  # a dive: WINDOW lines without weight
    surging = np.zeros(part[-1] + 1, bool)
    np.logical_or.at(surging, part, sums[heavy] > SHARE * sums.max())
    first, last = np.searchsorted(part, np.arange(part[-1] + 1)), np.searchsorted(part, np.arange(part[-1] + 1), "right") - 1
    return [(int(heavy[first[k]]), int(heavy[last[k]])) for k in np.flatnonzero(surging)]


def weights(lines: list[tuple[str, int, int, int, bool, int]]) -> list[int]:
    """What each line counts in the window sums: its characters outside of links; inside the main part, or an article where the page names no main part,
    ARTICLE-fold, and all of its characters but in a doubtful part."""
    place = 2 if any(x[3] == 2 for x in lines) else 1
    return [x[2] if x[3] < place else ARTICLE * (x[2] if x[4] else x[1]) for x in lines]


def main_text(html: str | None) -> str:
    """The lines from surge to dive; and of an article with such a line, and of the main part, every line that isn't in a doubtful part, so that the sums
    cut nothing out of what the page itself calls its article."""
    if not html:
        return ""
    lines = Page(html).lines
    keep = {i for a, b in kept_lines(weights(lines)) for i in range(a, b + 1)}
    surged = {lines[i][5] for i in keep if lines[i][3] == 1}
    keep |= {i for i, x in enumerate(lines) if not x[4] and (x[3] == 2 or x[3] == 1 and x[5] in surged)}
    return "\n".join(lines[i][0] for i in sorted(keep) if lines[i][0])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"page_id": x["page_id"], "url": x["url"], "text": [main_text(h) for h in x["html"]]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(column(html), F.lit("")).alias("html"))
    return rows.mapInPandas(of, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_html": op2_html}
