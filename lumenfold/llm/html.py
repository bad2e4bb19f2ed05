"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser gives start, end and text events.  Text between block
boundaries is a line.  A line's ratio is its characters over its tags; characters of links count as tags do.  The ratios, smoothed by
a Gaussian along the page, fall into two clusters whose midpoint is the threshold; lines above it are the
page's content region.  The region decides first: its container is the deepest element that holds nearly all of
it (articles or a main element before any other), and every block of the container belongs to the article, however short.

Names and tags only take away.  Elements for menus, footers, sidebars, scripts and the like hold no article text.  An element whose
class, id or role names such a part, or a form, goes too, unless it holds most of the region (of the text in article and main elements, where
the page has any): then it is the page's frame, whatever its name says.  Classes that tell a state (has-sidebar, comments-open) name no part.  Where the container is no article or main element, blocks
below the threshold that are mostly links go as well.

Every step is linear in the page's size.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches
from lumenfold.llm._text import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that never hold article text.
APART = frozenset("aside button canvas datalist dialog footer head iframe input menu nav noscript object script select style svg template textarea title".split())
#: Words of class, id or role that name such an element.
NAMES = frozenset(
    "ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs consent contentinfo cookie cookies footer "
    "login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget widgets complementary".split()
)
#: These words count outside articles only.
OUTER = frozenset(("header", "masthead", "top"))
COMMENTS = frozenset(("comment", "comments", "commentlist", "disqus", "respond"))
#: A class with one of these words tells how its element is, not what it is.
STATES = frozenset("has no not with without is open opened closed enabled disabled status allow allowed".split())
ARTICLE = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body"))
#: What can be the article's container.
CONTAINERS = ARTICLE | ROOTS | {"div", "section", "td", "center", "form"}
SIGMA = 2.0
#: Share of the region's characters that its container must hold.
SHARE = 0.9
LINKS = 0.5
#: Share of the region's characters from which an element is the page's frame.
FRAME = 0.5

_split = re.compile(r"[^a-z0-9]+").split
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_unseen = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search
_begun = re.compile(r"<[a-zA-Z/!?]").search


class _Lines(HTMLParser):
    """Collects elements, numbered as they open, and lines: text, tags, characters in links, the element around it.

    The elements inside element n are those from n to last[n].
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = [("", 0)]  # tag, number
        self.kinds, self.parent, self.last = [""], [0], [0]
        self.apart, self.named, self.said_comments = [False], [False], [False]
        self.open: dict[str, list[int]] = {}  # places in the stack
        self.blocks = [0]  # places of block elements in the stack
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1][1]))
            self.text = []
        self.tags = self.linked = 0

    def _judge(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
        """(holds no article text, is named as a part around the article, is named as comments)."""
        if tag in ROOTS:
            return False, False, False
        inner = any(self.open.get(t) for t in ARTICLE)
        apart, named, comments = tag in APART, tag == "form" or (tag == "header" and not inner), False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                apart = True
            elif name == "style" and value and _unseen(value):
                apart = True
            elif name in ("class", "id", "role") and value:
                for token in value.split():
                    said = set(_split(_camel.sub("-", token).lower()))
                    if said & STATES:
                        continue
                    comments |= bool(said & COMMENTS)
                    named |= tag not in ARTICLE and bool(said & NAMES or (not inner and said & OUTER))
        return apart, named, comments

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag == "p" or tag in HEADINGS:
            self._close("p")
        elif tag in ("li", "option", "tr", "td", "th", "dd", "dt"):
            self._close(tag, ("ul", "ol", "table", "dl", "select", "menu"))
        number = len(self.kinds)
        self.kinds.append(tag)
        self.parent.append(self.stack[-1][1])
        self.last.append(number)
        for marks, mark in zip((self.apart, self.named, self.said_comments), self._judge(tag, attrs), strict=True):
            marks.append(mark)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, number))

    def _close(self, tag: str, until: tuple[str, ...] = ("article", "aside", "blockquote", "body", "div", "footer", "form", "header", "li", "main", "nav", "section", "td")) -> None:
        """End an open ``tag`` whose end tag was left out."""
        if at := self.open.get(tag):
            if all(not (other := self.open.get(t)) or other[-1] < at[-1] for t in until if t != tag):
                self._flush()
                self._pop(at[-1])

    def _pop(self, at: int) -> None:
        number = len(self.kinds) - 1
        for tag, n in self.stack[at:]:
            self.open[tag].pop()
            self.last[n] = number
        del self.stack[at:]
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        if at := self.open.get(tag):
            # an inline element does not end the blocks inside it
            if tag in BLOCK or at[-1] > self.blocks[-1]:
                self._pop(at[-1])
        elif tag == "p":
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] in ("script", "style", "template", "noscript"):
            return
        self.text.append(data)
        if self.open.get("a"):
            self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def end(self) -> None:
        self.close()
        self._flush()
        self._pop(1)
        self.last[0] = len(self.kinds) - 1


def _read(html: str) -> _Lines:
    # a comment, and then a tag, that never ends takes the rest of the page with it
    if (at := html.find("<!--", html.rfind("-->") + 1)) >= 0:
        html = html[:at]
    tail = html.rfind(">") + 1
    if found := _begun(html, tail):
        html = html[: found.start()]
    try:
        parser = _Lines()
        parser.feed(html)
        parser.end()
    except AssertionError:  # a marked section that the parser does not know: read it as a declaration
        parser = _Lines()
        parser.feed(html.replace("<![", "<!"))
        parser.end()
    return parser


def _down(marks: list[bool], parent: list[int]) -> np.ndarray:
    """Marks handed to everything inside."""
    out = list(marks)
    for n in range(1, len(out)):
        out[n] = out[n] or out[parent[n]]
    return np.array(out)


def _mass(line: np.ndarray, weight: np.ndarray, parent: list[int]) -> list[float]:
    """The weight of all lines inside each element."""
    out = np.bincount(line, weights=weight, minlength=len(parent)).tolist()
    for n in range(len(out) - 1, 0, -1):
        out[parent[n]] += out[n]
    return out


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; the ends are weighed by what there is."""
    if len(ratio) < 2:
        return ratio.astype(float)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint between the means of the low and the high cluster (two means on a line)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all() or not upper.any():
            return cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The article's blocks joined by newlines; empty for null or where there is no text."""
    if not html:
        return ""
    page = _read(html)
    lines = page.lines
    if not lines:
        return ""
    around = np.array([x[3] for x in lines])
    size = np.array([len(x[0]) for x in lines], dtype=float)
    linked = np.minimum(np.array([x[2] for x in lines], dtype=float), size)
    ratio = (size - linked) / np.maximum(1, np.array([x[1] for x in lines]))
    never = _down([a or b for a, b in zip(page.apart, page.said_comments, strict=True)], page.parent)[around]
    # the region as the ratios give it, or what stands in articles; then what names take from it: all but the elements that hold most of it
    level = smooth(np.where(never, 0.0, ratio))
    region = ~never & (level >= threshold(level))
    marked = ~never & _down([kind in ARTICLE for kind in page.kinds], page.parent)[around]
    held = _mass(around, np.where(marked if marked.any() else region, size, 0.0), page.parent)
    frame = FRAME * held[0]
    gone = never | _down([named and held[n] < frame for n, named in enumerate(page.named)], page.parent)[around]
    if gone.all():
        return ""
    level = smooth(np.where(gone, 0.0, ratio))
    cut = threshold(level)
    region = ~gone & (level >= cut)
    if not region.any():
        region = ~gone
    held = _mass(around, np.where(region, size, 0.0), page.parent)
    fit = [n for n in range(1, len(held)) if held[n] >= SHARE * held[0] and page.kinds[n] in CONTAINERS]  # a chain, from the outermost
    named = [n for n in fit if page.kinds[n] in ARTICLE]
    articles = [n for n in range(1, len(held)) if page.kinds[n] == "article" and held[n] > 0]
    whole = True
    if named and page.kinds[named[-1]] == "article" or (articles and not named and sum(held[n] for n in articles if not any(page.kinds[m] == "article" for m in _above(n, page.parent))) >= SHARE * held[0]):
        chosen = [n for n in range(1, len(held)) if page.kinds[n] == "article"]
    elif named:
        chosen = [named[-1]]
    else:
        whole = False
        chosen = fit[-1:]
        if chosen and int(((around >= chosen[0]) & (around <= page.last[chosen[0]]) & ~gone).sum()) == 1:
            # one block's own wrapper: the article is the element around it
            chosen = [next((n for n in _above(chosen[0], page.parent) if page.kinds[n] in CONTAINERS), chosen[0])]
    inside = np.zeros(len(page.kinds) + 1, np.int64)
    for n in chosen:
        inside[n] += 1
        inside[page.last[n] + 1] -= 1
    mine = (np.cumsum(inside)[around] > 0) | (not chosen)
    keep = ~gone & mine & (whole | ~((linked > LINKS * size) & (level < cut)))
    return "\n".join(lines[i][0] for i in np.flatnonzero(keep))


def _above(n: int, parent: list[int]):
    """The elements around element n, from the innermost."""
    while n := parent[n]:
        yield n


def _extracted(batches):
    for rows, _, _ in pieces(batches, "html"):
        texts = [main_text(x) for x in rows.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without article text, have an empty text.  Rows may repeat; null page_id and url
    stay null.  Other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    typed = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return typed.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
