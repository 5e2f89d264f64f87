"""Main text of web pages, by the distribution of text over line blocks.

Markup is stripped first: comments, scripts, styles and forms, and elements that their
own name, role, class or id calls menus, headers, footers, sidebars, notices, adverts
or reader comments. What is left is written as lines, one for each block of text, with
an empty line for every container that begins or ends between two of them. A window of
``WINDOW`` lines slides over them and sums their text, without that of links. Text
surges where the sum leaves zero and dives where it comes back; what stands between the
two is kept if the sum reaches ``SURGE`` characters there, or half of the page's
greatest sum where a page has less text. Lines of links at either end go.

A page that marks its article (``article``, ``main``, or a container named like one)
has no text elsewhere: lines outside count as empty, and inside one article only
stripped parts are missing, so short paragraphs and lists of links stay.

How it runs. A function of one row: ``mapInArrow`` over the page's columns, one page at
a time, without a shuffle, in time and memory linear in the page.

Defined results: a null or empty page has an empty text; repeated rows give repeated
rows; an element that is never closed ends with its parent or the page, and is not
stripped if it holds more than half of the text; other columns are ignored. White space
is that of Unicode, ``br`` included; a comment that never ends takes the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 86
# A stripped container with more text than this, and most of the page's, was misnamed.
LARGE = 1000

# Elements that end a line.
_CONTAINERS = frozenset(
    "article aside body center dialog div fieldset footer form header hgroup html main menu nav search section table".split()
)
_BLOCKS = _CONTAINERS | frozenset(
    "address blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol p pre summary "
    "tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup, or none of a page's text.
_RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
_JUNK = frozenset("audio button canvas datalist map object select svg video".split())
_STRIPPED = frozenset("aside dialog footer form menu nav search".split())
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
_REMARKS = frozenset("comment comments commentlist disqus replies reply respond".split())
_NAMES = _REMARKS | frozenset(
    "ad ads adsbygoogle adsense adv advert advertisement advertising adverts aside banner breadcrumb breadcrumbs "
    "consent cookie cookies copyright footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "overlay pager pagination popular popup promo promotion promotions recommendations recommended related share "
    "sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar trending "
    "widget widgets".split()
)
_DENIED = frozenset("has with without no not free".split())
_ARTICLES = frozenset(
    "article article-body article-content articlebody content content-body entry entry-content main main-content "
    "maincontent post post-body post-content story story-body story-content".split()
)

# Start of an item that ends those before it: name -> names that it closes.
_ENDS = {
    "li": {"p", "li"},
    "dt": {"p", "dt", "dd"},
    "dd": {"p", "dt", "dd"},
    "tr": {"p", "td", "th", "tr"},
    "td": {"p", "td", "th"},
    "th": {"p", "td", "th"},
}

# Every alternative uses up what it has read, so no text is read twice.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/><]*)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^<>])*+)(?:>|(?=<)|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}


def _attributes(text: str) -> dict[str, str]:
    if not _TELLING.search(text):
        return {}
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(text))}


def _called(name: str) -> set[str]:
    """The words that a class or id stands for: its first and last part, unless denied."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return set() if not parts or _DENIED & set(parts) else {parts[0], parts[-1], "".join(parts)}


class _Element:
    __slots__ = ("name", "start", "end", "stripped", "remarks", "hint", "hints", "closed", "vetoable")

    def __init__(self, name: str, start: int):
        self.name, self.start, self.end = name, start, None
        self.stripped = self.remarks = self.hints = self.closed = False
        self.vetoable = True
        self.hint = 0  # 3: article, 2: main, 1: named like one


def _judge(element: _Element, attributes: dict[str, str], inside: bool) -> None:
    """What an element's name and attributes say about it."""
    name = element.name
    names = [*attributes.get("class", "").split(), *attributes.get("id", "").split()]
    words = set().union(*map(_called, names)) if names else set()
    role = attributes.get("role", "").lower()
    element.remarks = bool(words & _REMARKS)
    if name in ("html", "body"):
        return
    if name == "article" or name == "main" or role == "main" or attributes.get("itemprop") == "articleBody":
        # An article can be a remark of a reader; other names do not speak against it.
        element.stripped = name == "article" and any(_PARTS.findall(x)[:1] == ["comment"] for x in names)
        element.remarks &= element.stripped
        element.hint = 0 if element.stripped else 3 if name == "article" else 2
        return
    hidden = (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    )
    header = (name == "header" or "header" in words and name in _CONTAINERS) and not inside
    element.stripped = name in _STRIPPED or header or role in _ROLES or hidden or bool(words & _NAMES)
    element.vetoable = name not in ("footer",) and not element.remarks
    if not element.stripped and {x.lower() for x in names} & _ARTICLES:
        element.hint = 1


class _Page:
    """Lines of a page and the elements over them."""

    def __init__(self, source: str):
        self.lines: list[str] = []
        self.weights: list[int] = []  # text without links
        self.gaps: list[int] = []  # containers that begin or end before the line
        self.elements: list[_Element] = []
        self._stack: list[_Element] = []
        self._open: Counter = Counter()
        self._parts: list[str] = []
        self._linked = self._gap = 0
        self._link: int | None = None  # depth at which a link began
        self._skip: list | None = None  # name, nesting and depth of what is skipped inside a line
        self._read(source)

    def _text(self, text: str) -> None:
        if self._skip or not text:
            return
        text = html.unescape(text) if "&" in text else text
        self._parts.append(text)
        if self._link is not None:
            self._linked += len("".join(text.split()))

    def _line(self) -> None:
        if not self._parts:
            return
        words = "".join(self._parts).split()
        if words:
            self.lines.append(" ".join(words))
            self.weights.append(max(0, sum(map(len, words)) - self._linked))
            self.gaps.append(self._gap)
            self._gap = 0
        self._parts, self._linked = [], 0

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        element = _Element(name, len(self.lines))
        _judge(element, attributes, any(self._open[x] for x in ("article", "main")))
        self.elements.append(element)
        self._stack.append(element)
        self._open[name] += 1
        self._gap += name in _CONTAINERS

    def _pop(self, closed: bool) -> _Element:
        element = self._stack.pop()
        self._open[element.name] -= 1
        element.end, element.closed = len(self.lines), closed
        self._gap += element.name in _CONTAINERS
        if self._stack:
            self._stack[-1].hints |= element.hints or element.hint > 1
        depth = len(self._stack)
        if self._link is not None and depth < self._link:
            self._link = None
        if self._skip and depth < self._skip[2]:
            self._skip = None
        return element

    def _start(self, name: str, attributes: str) -> None:
        if name not in _BLOCKS:
            if name == "br":
                self._text(" ")
            elif self._skip:
                self._skip[1] += name == self._skip[0]
            elif name not in _VOID:
                found = _attributes(attributes)
                element = _Element(name, 0)
                if found:
                    _judge(element, found, True)
                if name in _JUNK or element.stripped:
                    self._skip = [name, 1, len(self._stack)]
                elif name == "a":
                    self._link = len(self._stack)
            return
        self._line()
        closes = _ENDS.get(name, {"p"})
        while self._stack and self._stack[-1].name in closes:
            self._pop(True)
        if name != "hr":
            self._push(name, _attributes(attributes))

    def _end(self, name: str) -> None:
        if name not in _BLOCKS:
            if self._skip and name == self._skip[0]:
                self._skip[1] -= 1
                if not self._skip[1]:
                    self._skip = None
            elif name == "a":
                self._link = None
            return
        self._line()
        if self._open[name]:
            while (element := self._pop(self._stack[-1].name == name)).name != name:
                pass

    def _read(self, source: str) -> None:
        at = 0
        while found := _TOKEN.search(source, at):
            self._text(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            name = found[2].lower()
            if found[1]:
                self._end(name)
            elif name in _RAW:
                end = _RAW_ENDS[name].search(source, at)
                at = end.start() if end else len(source)
            else:
                self._start(name, found[3])
        self._text(source[at:])
        self._line()
        while self._stack:
            self._pop(False)


def _spread(elements: list[_Element], n: int) -> list[int]:
    """How many of the elements each line is in."""
    change = [0] * (n + 1)
    for e in elements:
        change[e.start] += 1
        change[e.end] -= 1
    out, now = [], 0
    for c in change[:n]:
        now += c
        out.append(now)
    return out


def _regions(page: _Page, gone: list[int]) -> list[int] | None:
    """The article each line is in, 0 for none; None if the page marks no article."""
    n = len(page.lines)
    for level in (3, 2, 1):
        out, number, end = [0] * n, 0, 0
        for e in page.elements:  # in the order in which they begin, so the outer is first
            if e.hint == level and e.start >= end and e.end > e.start:
                number, end = number + 1, e.end
                out[e.start : end] = [number] * (end - e.start)
        if any(r and not g for r, g in zip(out, gone, strict=True)):
            return out
    return None


def _stripped(page: _Page) -> list[int]:
    """For each line, whether it is in something stripped."""
    sums = [0]
    for w in page.weights:
        sums.append(sums[-1] + w)

    def misnamed(e: _Element) -> bool:
        inside = sums[e.end] - sums[e.start]
        return 2 * inside > sums[-1] and (not e.closed or inside > LARGE)

    marked = any(e.hint > 1 and e.end > e.start for e in page.elements)
    named = [e for e in page.elements if e.stripped and (marked or not e.vetoable or not misnamed(e))]
    gone = _spread(named, len(page.lines))
    left = [0]
    for g in gone:
        left.append(left[-1] + (not g))
    if marked and not any(e.hint > 1 and left[e.end] > left[e.start] for e in page.elements):
        # All articles lie in something stripped: an unclosed menu, a form around the page.
        gone = _spread([e for e in named if not e.hints], len(page.lines))
    return gone


def extract(source: str | None) -> str:
    """The main text of one page, its blocks joined by two newlines."""
    if not source:
        return ""
    page = _Page(source)
    gone = _stripped(page)
    regions = _regions(page, gone)
    # The lines as the window sees them: text, and empty lines between.
    grid: list[tuple[int, int]] = []  # line (-1: empty), weight
    gap, before = 0, 0
    for i, line in enumerate(page.lines):
        gap += page.gaps[i]
        if gone[i] or regions and not regions[i]:
            continue
        if regions:
            gap = 0 if regions[i] == before else WINDOW
            before = regions[i]
        grid += [(-1, 0)] * min(gap, WINDOW)
        grid.append((i, len(line) if regions else page.weights[i]))
        gap = 0
    weights = [w for _, w in grid]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    # A line counts where any window over it has text.
    surge = min(SURGE, max(sums, default=0) / 2)
    kept: list[str] = []
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive]:
            dive += 1
        if max(sums[i:dive]) >= surge:
            stretch = grid[i:dive]
            texts = [k for k, (_, w) in enumerate(stretch) if w]
            kept += [page.lines[line] for line, _ in stretch[texts[0] : texts[-1] + 1] if line >= 0]
        i = dive
    return "\n\n".join(kept)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source = batch["html"]
        texts = [extract(source[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.selectExpr("cast(page_id AS long) page_id", "cast(url AS string) url", "cast(html AS string) html")
    return rows.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
