"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, clustering.

The standard library's parser gives the page as a stream of events; each block
of text becomes a line with its characters, its tags and the element it stands
in. The ratio of characters to tags is lowered for each form, and each element
named like side matter, that a line stands in; smoothed along the lines with a
Gaussian kernel; and split in two clusters. The element that holds the lines of
the high cluster is the content region. Its text is all of its lines but those
in side matter whose own ratio, so lowered, falls in the low cluster.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NO_TEXT = frozenset("canvas head iframe noscript object option script select style svg template textarea title".split())
SIDE = frozenset("aside button dialog footer menu nav".split())
SCOPES = frozenset("article aside blockquote body div footer form header html main nav ol section table td th ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class, id and role that name side matter.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus "
    "footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted "
    "recommended related search share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split()
)
_WORD = re.compile(r"[a-z]+")
SIGMA = 1.0
#: What a ratio is multiplied by for each form, or element named like side matter, around its line.
LOWERED = 0.05
#: Share of the high cluster's text that the content region holds at least.
REGION = 0.8
_HEADS = ("article", "main", "h1")
_LEAVES = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 pre".split())


class _Lines(HTMLParser):
    """Lines of (text, tags, element number); elements by number, each after its parent; side matter by tag is left out.

    Open elements are counted by tag, so that nothing is looked for in the stack
    that isn't there: the work grows with the page, however deep it is nested.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.side = [0], [""], [False]
        self.stack: list[int] = []
        self.open: dict[str, int] = {}
        self.closed = 0  # open elements whose text is never part of an article
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append((text, max(1, self.tags), self.stack[-1] if self.stack else 0))
            self.tags = 0

    def pop(self, size: int) -> None:
        """Closes all but the first `size` open elements."""
        while len(self.stack) > size:
            tag = self.tag[self.stack.pop()]
            self.open[tag] -= 1
            self.closed -= self.hard(tag)

    def hard(self, tag: str) -> bool:
        return tag in NO_TEXT or tag in SIDE

    def pop_to(self, tags: frozenset | set, scopes: frozenset) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.tag[self.stack[k]]
            if tag in tags:
                self.pop(k)
                return
            if tag in scopes:
                return

    def inside(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def named_side(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("form", "input") or tag == "header" and not self.inside():
            return True
        if tag in ("html", "body", "article", "main") or tag in INLINE:
            return False
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        words = set(_WORD.findall(named))
        if tag == "header":
            words -= {"header"}
        return bool(words & SIDE_WORDS) or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self.cut()
            self.pop_to({"p"}, SCOPES)
            if tag in CLOSES:
                self.pop_to(CLOSES[tag], SCOPES - {"td", "th"} if tag == "tr" else SCOPES - CLOSES[tag])
            if tag in ("article", "main", "body"):
                self.pop_to({"nav", "head"}, frozenset())  # left open
        if tag not in VOID:
            self.parent.append(self.stack[-1] if self.stack else 0)
            self.side.append(self.named_side(tag, attrs))
            self.stack.append(len(self.tag))
            self.tag.append(tag)
            self.open[tag] = self.open.get(tag, 0) + 1
            self.closed += self.hard(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.cut()
        self.pop_to({tag}, SCOPES - {tag} if tag in INLINE or tag == "p" else frozenset())

    def handle_data(self, data: str) -> None:
        if not self.closed:
            self.parts.append(data)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines, with the kernel renormalised at the ends."""
    r = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = lambda v: np.convolve(v, kernel)[r : r + len(v)]
    return full(x) / full(np.ones(len(x)))


def threshold(x: np.ndarray) -> float:
    """The border of two clusters: the midpoint of their means, found in turns."""
    at = float(x.mean())
    for _ in range(50):
        high, low = x[x >= at], x[x < at]
        if not len(high) or not len(low) or (new := (high.mean() + low.mean()) / 2) == at:
            break
        at = float(new)
    return at


def _inside(parent: list[int], own: list[float]) -> list[float]:
    """The sum of each element's own values and those of all within it."""
    for e in range(len(own) - 1, 0, -1):
        own[parent[e]] += own[e]
    return own


def main_text(html: str | None) -> str:
    """The article of a page, a line per block; empty for a page without one."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines, parent, tag = parser.lines, parser.parent, parser.tag
    if not lines:
        return ""
    size, heads = [0.0] * len(tag), [float(t in _HEADS) for t in tag]
    for text, _, e in lines:
        size[e] += len(text)
    size, heads = _inside(parent, size), _inside(parent, heads)
    # what holds most of the text and its heading is no side matter, whatever its name
    side = [x and not (h and n > size[0] / 2) for x, n, h in zip(parser.side, size, heads)]
    depth = [0] * len(tag)
    for e in range(1, len(tag)):
        depth[e] = depth[parent[e]] + side[e]
    score = np.array([len(t) / tags * LOWERED ** depth[e] for t, tags, e in lines])
    ratio = smoothed(score)
    border = threshold(ratio)
    weight = [0.0] * len(tag)
    for (text, _, e), high in zip(lines, ratio >= border):
        weight[e] += len(text) * LOWERED ** depth[e] if high else 0.0
    weight = _inside(parent, weight)
    region = max(e for e in range(len(tag)) if e == 0 or weight[e] >= REGION * weight[0] and tag[e] not in INLINE and tag[e] not in _LEAVES)
    up = region
    while up and tag[up] not in ("article", "main"):
        up = parent[up]
    region = up or region
    # side matter in the region, by its outermost element
    within, part = [False] * len(tag), [0] * len(tag)
    within[region] = True
    for e in range(region + 1, len(tag)):
        within[e] = within[parent[e]]
        part[e] = part[parent[e]] or (e if side[e] else 0)
    worth: dict[int, list[float]] = {}
    for (text, tags, e), x in zip(lines, score):
        if within[e] and part[e]:
            sums = worth.setdefault(part[e], [0.0, 0.0])
            sums[0], sums[1] = sums[0] + x * tags, sums[1] + tags
    kept = {e for e, (chars, tags) in worth.items() if chars / tags >= border}
    return "\n".join(t for t, _, e in lines if within[e] and (not part[e] or part[e] in kept))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, *keep, text, n_chars) for each page, from its whole html.

    Null and empty html, and pages without text, give an empty text. Equal rows
    give equal rows; an empty table gives none; columns not named aren't read.
    Very long and very deep pages take time and memory in proportion.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), *keep, F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [main_text(h) for h in b.pop("html")]
            b["n_chars"] = b["text"].str.len().astype("int64")
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "html")
    return rows.mapInPandas(run, f"{schema}, text string, n_chars long")
