"""Operator 7: main text of HTML pages by smoothed text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one per block element,
each with its text, its number of tags and its place in the element tree. What a page marks
as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments,
by elements, classes, ids or roles, is no content: its lines have the ratio 0 and are never
returned. The text-to-tag ratios are smoothed with a Gaussian over neighbouring lines; lines
at or above the threshold (the standard deviation of the smoothed ratios) form clusters, and
a cluster's mass is its characters. The masses select the content regions: the top-level
``article`` and ``main`` elements that hold part of a cluster, if these hold at least
``HINTED`` of all mass together, else the deepest element with nine tenths of it. All lines
of the regions are the main text, in page order, so short paragraphs next to long ones stay.

Parsing is linear in the page, however deep its elements nest: the parser keeps a stack and
the places of each name on it, elements are numbered as they open, and an element's lines are
those of a range of numbers.

Defined cases: null, empty and text-free html give an empty string; character references
are decoded; white space inside a block becomes one space; unclosed and stray tags are
tolerated; null or repeated ids are carried; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from scholium.llm.shared import given_back, sent_id

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object select textarea button canvas audio video map datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
REGIONS = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PEERS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
LISTS = frozenset(("ul", "ol", "dl", "table"))
SCOPES = frozenset("ul ol dl table body article main section div nav aside footer header form html td th blockquote".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|pagination|pager|widget|toolbar|skip-link|site-header|page-header|topbar)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: The least share of all cluster mass by which article and main elements are the content regions.
HINTED = 0.2
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


@dataclass
class Line:
    text: str
    tags: int
    node: int  # number of the block element that holds it
    region: int  # number of the top-level article or main around it, else 0
    hidden: bool


@dataclass
class Open:
    name: str
    node: int
    region: int
    hidden: bool
    silent: bool


class LineParser(HTMLParser):
    """Parser events as lines. Block elements are numbered as they open; 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Open("#root", 0, 0, False, False)]
        self.places: dict[str, list[int]] = defaultdict(list)  # of each open name on the stack
        self.blocks = [0]  # places of open block elements
        self.names = ["#root"]
        self.parent, self.depth, self.last = [0], [0], [0]  # by number; ``last`` is the highest number inside
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            block = self.stack[self.blocks[-1]]
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, block.node, top.region, top.hidden))
        self.tags = 0

    def _pop_to(self, place: int) -> None:
        """Close elements until ``place`` are open."""
        if self.blocks[-1] >= place:
            self._flush()
        while len(self.stack) > place:
            gone = self.stack.pop()
            if gone.name:
                self.places[gone.name].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
                self.last[gone.node] = len(self.names) - 1

    def _innermost(self, names: tuple[str, ...] | frozenset[str]) -> int:
        """The highest place of an open element of these names; 0 if none is open."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def _close(self, names: tuple[str, ...], limits: frozenset[str]) -> None:
        """An end tag that the page left out."""
        place = self._innermost(names)
        if place and place > self._innermost(limits):
            self._pop_to(place)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.parts.append(" ")
            if tag == "hr":
                self._flush()
            self.tags += 1
            return
        if tag in CLOSES_P:
            self._close(("p",), SCOPES)
        if tag in PEERS:
            self._close(tuple(PEERS[tag].split()), LISTS)
        if tag == "body":
            self._close(("head",), frozenset())
        if tag not in INLINE:
            self._flush()
        top = self.stack[-1]
        node, region, hidden = top.node, top.region, top.hidden
        if not hidden:
            hidden = tag in BOILERPLATE or tag in SILENT or tag == "header" and not region or tag not in ("html", "body", *REGIONS) and self._marked(dict(attrs))
        if tag not in INLINE:
            node, above = len(self.names), self.stack[self.blocks[-1]].node
            self.names.append(tag)
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.last.append(node)
            self.blocks.append(len(self.stack))
            if tag in REGIONS and not region:
                region = node
        self.places[tag].append(len(self.stack))
        self.stack.append(Open(tag, node, region, hidden, top.silent or tag in SILENT))
        self.tags += 1

    @staticmethod
    def _marked(held: dict) -> bool:
        if "hidden" in held or held.get("aria-hidden") == "true" or (held.get("role") or "").lower() in ROLES:
            return True
        if "style" in held and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", held["style"] or ""):
            return True
        return any(held.get(k) and MARKED.search(held[k]) for k in ("class", "id"))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        place = self._innermost((tag,))
        if not place:
            return
        if tag in INLINE and self.blocks[-1] > place:  # an inline end beyond a block's edge
            self.places[tag].pop()
            self.stack[place].name = ""
            return
        self._pop_to(place)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.silent or top.hidden and top.name in INLINE:  # the latter is marked, inside a visible block
            return
        self.parts.append(data)

    def end(self) -> None:
        self.close()
        self._pop_to(1)
        self._flush()
        self.last[0] = len(self.names) - 1


def smoothed_ratios(lines: list[Line], sigma: float = 1.5) -> np.ndarray:
    """Characters per tag of each line, 0 for marked ones, smoothed over neighbouring lines."""
    ratio = np.array([0.0 if x.hidden else len(x.text) / max(1, x.tags) for x in lines], np.float64)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


def content_lines(html: str) -> list[Line]:
    """The lines of the selected regions that are not marked as boilerplate."""
    page = LineParser()
    page.feed(html)
    page.end()
    shown = [x for x in page.lines if not x.hidden]
    if not shown:
        return []
    smooth = smoothed_ratios(page.lines)
    dense = smooth >= smooth.std()
    cluster = [x for x, d in zip(page.lines, dense.tolist(), strict=True) if d and not x.hidden] or shown
    total = sum(len(x.text) for x in cluster)
    hinted = {x.region for x in cluster if x.region}
    if hinted and sum(len(x.text) for x in cluster if x.region) >= HINTED * total:
        return [x for x in shown if x.region in hinted]
    mass = [0] * len(page.names)
    for x in cluster:
        mass[x.node] += len(x.text)
    for node in range(len(mass) - 1, 0, -1):  # children have higher numbers
        mass[page.parent[node]] += mass[node]
    region = max((n for n, m in enumerate(mass) if 10 * m >= 9 * total), key=lambda n: page.depth[n])
    if page.names[region] in CLOSES_P - {"div", "section"}:  # a block alone is no region
        region = page.parent[region]
    return [x for x in shown if region <= x.node <= page.last[region]]


def main_text(html: str | None) -> str:
    return "\n\n".join(x.text for x in content_lines(html)) if html else ""


def _extract(batches):
    import pandas as pd

    for batch in batches:
        texts = [main_text(h) for h in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    rows = pages.select(sent_id("page_id"), "url", "html").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
    return given_back(rows, "page_id")
