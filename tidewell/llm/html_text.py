"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser gives a stream of events, from which a page becomes lines: one
per block element, with its text, the number of tags in it and how much of the text is link.
The text-to-tag ratio of the lines is smoothed with a Gaussian and split into two clusters;
runs of lines in one container are regions.

The region with the most text of the upper cluster is content (the first of several).  If it
stands in an article (or else a main) element, the regions of that element are content but
for those that are mostly links, and those of a ``div`` or ``section`` whose ratio is below a
quarter of the clusters' threshold, unless the container looks like that of a better region
(the same element and class) or holds a heading.  Elsewhere, regions are content of which the upper
cluster holds at least half, or whose container looks like one of these; so are headings
before content, and between such regions those in other elements than ``div`` and ``section``.
Inside a region nothing is dropped, so short paragraphs stay.

In an article whose upper text stands in boxes directly, as paragraphs do elsewhere, short
boxes stay as well.

Elements that can't be article text (scripts, navigation, asides, forms, page headers and
footers, hidden ones, and containers that are named as comments) are lines for the clustering,
but never content.  Containers whose class, id or role names some other such part aren't either,
as long as there is other text in the upper cluster or an article: else the clusters alone
decide.  Names that articles use for parts of their own (``WEAK``) leave out nothing in an article that
the upper cluster holds at least half of.  Names of headings and inline elements decide nothing, nor
does that of an outermost article or main element, unless it says that it is a comment.

Pages are handled by themselves in Arrow tasks: no shuffle; memory is that of one page's text.

Defined results: null, empty or text-free html gives an empty text; broken markup is read as
far as the parser goes on; of regions with equally much text of the upper cluster the larger,
then the first is taken; repeated rows repeat; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values: element names and naming words of HTML practice
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("script style noscript template nav footer aside form button select option textarea iframe object svg canvas video audio head title dialog menu fieldset".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar "
    "widget footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments commentlist discussion reply replies respond responses feedback disqus pagination pager toolbar legal copyright disclaimer skip teaser toc search complementary contentinfo".split()
)
#: Names of parts that an article may have too.
WEAK = frozenset("legal copyright disclaimer discussion search alert feedback notification skip teaser complementary".split())
COMMENT = frozenset("comment comments commentlist disqus reply replies response responses".split())
#: Beside these, "header" names the heading of an article.
ARTICLE = frozenset("article content post entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("script style noscript template head title select option textarea iframe object svg canvas video audio".split())
#: An open element of the first kind ends where one of the second begins.
ENDS_AT = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: Blocks that are parts of the container they stand in.
PARTS = frozenset("p li dt dd td th tr tbody thead tfoot caption figcaption".split())
BOXES = frozenset("div section".split())
#: How far an element is left out.
MAYBE, NAME, ALWAYS = 1, 2, 3
CHUNK = 1 << 16


class Line:
    """Text of one block, its tags, the code points of it that are links, and where it stands (``direct``: in a box itself)."""

    __slots__ = ("article", "direct", "heading", "links", "out", "parts", "place", "tags")

    def __init__(self, place: int, article: int, out: int, heading: bool, direct: bool):
        self.parts: list[str] = []
        self.tags, self.links, self.place, self.article, self.out, self.heading, self.direct = 1, 0, place, article, out, heading, direct


class PageLines(HTMLParser):
    """Parser events to lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # name, how far left out, container
        self.skipping = [0] * 4  # open elements by how far they are left out
        self.silent = self.links = self.marked = self.headings = 0
        self.looks: list[tuple[str, str]] = [("", "")]  # of each container: element and class
        self.lines: list[Line] = []
        self.fresh = True

    def _left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """``ALWAYS``, by a ``NAME``, by a name that ``MAYBE`` an article's, or 0."""
        if tag in SKIPPED or tag == "header" and not self.marked:
            return ALWAYS
        words: set[str] = set()
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                return ALWAYS
            if name in ("class", "id", "role") and value:
                words.update(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower()))
        if tag in INLINE or tag in HEADINGS or tag in ("html", "body"):
            return 0
        if words & COMMENT:
            return ALWAYS
        if tag in ("article", "main") and not self.marked:
            return 0
        named = words & NOISE - ({"header"} if words & ARTICLE else set())
        return (NAME if named - WEAK else MAYBE) if named else 0

    def _out(self) -> int:
        return max((level for level in (MAYBE, NAME, ALWAYS) if self.skipping[level]), default=0)

    def _pop(self) -> str:
        tag, out, _ = self.stack.pop()
        self.skipping[out] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        self.marked -= tag in ("article", "main")
        self.headings -= tag in HEADINGS
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("article", "main") and not self.marked:
            while self._out():  # an unclosed menu or advert ends where the article begins
                self._pop()
        while self.stack and tag in ENDS_AT.get(self.stack[-1][0], ()):
            self._pop()
        if tag not in INLINE:
            self.fresh = True
        elif self.lines and not self.silent:
            self.lines[-1].tags += 1
        if tag in VOID:
            return
        out = self._left_out(tag, attrs)
        if tag not in INLINE and tag not in HEADINGS and tag not in PARTS:
            place = len(self.looks)
            self.looks.append((tag, dict(attrs).get("class") or ""))
        else:
            place = self.stack[-1][2] if self.stack else 0
        self.stack.append((tag, out, place))
        self.skipping[out] += 1
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.marked += tag in ("article", "main")
        self.headings += tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.fresh = True
        if any(name == tag for name, _, _ in self.stack):
            while self._pop() != tag:
                pass

    def _article(self) -> int:
        """The outermost open article, or else the outermost main."""
        if not self.marked:
            return 0
        named = {tag: place for tag, _, place in reversed(self.stack) if tag in ("article", "main")}
        return named.get("article", named.get("main", 0))

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.fresh or self.lines[-1].out != self._out():
            if not data.strip():
                return
            block = next((tag for tag, _, _ in reversed(self.stack) if tag not in INLINE), "")
            self.lines.append(Line(self.stack[-1][2] if self.stack else 0, self._article(), self._out(), self.headings > 0, block in BOXES))
            self.fresh = False
        line = self.lines[-1]
        line.parts.append(data)
        if self.links:
            line.links += len(data)


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; beyond the ends there is nothing."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]
    return np.convolve(values, kernel)[radius : radius + len(values)] / weight


def two_clusters(values: np.ndarray) -> float:
    """The value that splits 1-d values into two clusters of least variance."""
    ordered = np.sort(values)
    n = len(ordered)
    if n < 2 or ordered[0] == ordered[-1]:
        return float(ordered[0]) if n else 0.0
    sums, squares = np.cumsum(ordered), np.cumsum(ordered**2)
    k = np.arange(1, n)
    within = squares[-1] - sums[:-1] ** 2 / k - (sums[-1] - sums[:-1]) ** 2 / (n - k)
    return float(ordered[int(np.argmin(within)) + 1])


class Region:
    """A run of lines in one container: indices, code points, those of upper lines and of links."""

    def __init__(self, lines: list[int], found: list[tuple[str, Line]], upper: np.ndarray, ratio: np.ndarray, look: tuple[str, str]):
        self.lines, self.look, self.box = lines, look, look[0] in BOXES
        self.weak, self.direct = found[lines[0]][1].out == MAYBE, all(found[i][1].direct for i in lines)
        self.size = sum(len(found[i][0]) for i in lines)
        self.high = sum(len(found[i][0]) for i in lines if upper[i])
        self.linked = 2 * sum(found[i][1].links for i in lines) > self.size
        self.article, self.ratio = found[lines[0]][1].article, max(ratio[i] for i in lines)
        self.headed = any(found[i][1].heading for i in lines)
        self.heading = all(found[i][1].heading for i in lines)


def content(found: list[tuple[str, Line]], looks: list[tuple[str, str]], sigma: float) -> list[int]:
    """The lines that are content."""
    ratio = np.array([0.0 if 2 * line.links > len(text) else len(text) / line.tags for text, line in found])
    score = smoothed(ratio, sigma)
    least = two_clusters(score)
    upper = (score >= least) & (ratio > 0)

    def regions_of(most: int) -> list[Region]:
        """Runs of lines in one container that are left out at most so far."""
        runs: list[list[int]] = []
        for i, (_, line) in enumerate(found):
            if line.out <= most:
                if runs and (found[runs[-1][-1]][1].place, found[runs[-1][-1]][1].out) == (line.place, line.out):
                    runs[-1].append(i)
                else:
                    runs.append([i])
        return [Region(run, found, upper, ratio, looks[found[run[0]][1].place]) for run in runs]

    every = regions_of(MAYBE)
    regions = [r for r in every if not r.weak]
    if not any(r.high or r.article for r in regions):  # names leave nothing, so the clusters decide
        every = [r for r in regions_of(NAME) if r.high] or regions
        regions = every
    if not regions:
        return []
    best = max(regions, key=lambda r: (r.high, r.size, -r.lines[0]))
    if best.article:
        regions = [r for r in every if r.article == best.article and (not r.weak or not r.linked and 2 * r.high >= r.size)]
        alike = {r.look for r in regions if 4 * r.ratio >= least and not r.linked}
        direct = 2 * sum(r.high for r in regions if r.direct) > sum(r.high for r in regions)
        return [i for r in regions if r is best or not r.linked and (not r.box or r.headed or r.look in alike or direct and r.direct) for i in r.lines]
    alike = {r.look for r in regions if r is best or r.box and not r.linked and 2 * r.high >= r.size}
    chosen = [r is best or not r.linked and (2 * r.high >= r.size or r.box and r.look in alike) for r in regions]
    for k in range(len(regions) - 1, -1, -1):  # headings before content
        chosen[k] |= regions[k].heading and not regions[k].linked and k + 1 < len(chosen) and chosen[k + 1]
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    return [i for k, r in enumerate(regions) if chosen[k] or first < k < last and not r.box and not r.linked for i in r.lines]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page."""
    parser = PageLines()
    for at in range(0, len(html or ""), CHUNK):
        parser.feed(html[at : at + CHUNK])
    if parser.rawdata.startswith("<!--"):
        parser.rawdata = ""  # a comment that is never closed
    parser.close()
    found = [(" ".join("".join(line.parts).split()), line) for line in parser.lines]
    found = [(text, line) for text, line in found if text]
    return " ".join(found[i][0] for i in content(found, parser.looks, sigma)) if found else ""


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """A row per page: page_id, url, text, n_chars (code points)."""
    fields = {f.name: f.dataType.simpleString() for f in pages.schema}

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(html, sigma) for html in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": np.array([len(t) for t in text], dtype=np.int64)})

    return pages.select("page_id", "url", "html").mapInPandas(texts, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars long")
