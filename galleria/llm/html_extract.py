"""HTML extraction: two-pass block rules.

A page is read as a stream of tags and text (unclosed, misnested and raw-text elements as browsers take them) and cut
into blocks at block-level tags. Pass one decides each block by itself: what stands in menus, headers, footers, sidebars,
forms, notices, adverts or reader comments (by element, role or the words of class and id) is boilerplate; so is a block
most of whose characters are links; a long block is text by its stop-word density, of which less is asked in the page's
article element. Short blocks stay open. Pass two gives each open block the label of its nearest decided neighbour (of two as
near, text wins if either is text); open blocks with no decided neighbour are text in an article element only.

Text: character references are decoded, white space in a block becomes one space, blocks are joined by one space in page
order; nothing is cut off.

Scale: map-only, one pass over the html; time is linear in its length. Defined results: null or empty html gives an empty
text; repeated rows are each extracted; extra columns are kept by extract(); an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, map_arrow

# Elements by their part in a page, and words that name boilerplate in class, id and role.
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_ELEMENTS = frozenset("script style noscript iframe noembed noframes template textarea title svg math object audio video canvas xmp".split())
BOILER_ELEMENTS = frozenset("nav header footer aside form menu button select dialog fieldset label input datalist output head applet".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense banner banners breadcrumb breadcrumbs byline comment comments "
    "commentlist commenting consent cookie cookies copyright disclaimer discussion disqus footer footnav gdpr header login masthead menu menus menubar "
    "modal nav navbar navigation navlinks newsletter notice notices notification overlay pagination paywall popup promo promos promotion "
    "recommended related reply replies respond rss share sharing sharebar shoutbox sidebar sidebars sidenav signup skip social sponsor sponsored "
    "sponsors subscribe subscription tagcloud tags teaser toolbar topbar trackback widget widgets".split()
)
KEEP_ELEMENTS = frozenset("html body article main".split())
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by can for from had has have he her his i in is it its not of on or our she that the their they this to was "
    "we were which will with would you your "
    # German
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht noch oder "
    "sich sie sind so um und von vor war wie wird zu zum zur über "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qui que sa se ses son sont "
    "sur un une vous à "
    # Spanish
    "al como con de del el ella en es esta este ha la las lo los más no o para pero por que se sin sobre su sus un una y ya".split()
)

#: A block of fewer characters is short; link and stop-word densities as shares of characters and words.
SHORT, LINKS, STOPS_HIGH, STOPS_LOW = 70, 0.5, 0.30, 0.15

_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

GOOD, BAD, OPEN = 1, -1, 0


def _marks_boilerplate(name: str, attrs: str) -> bool:
    if name in BOILER_ELEMENTS:
        return True
    if not attrs or name in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if name in KEEP_ELEMENTS:
            continue
        if key == "role" and value.strip().lower() in BOILER_ROLES:
            return True
        if key in ("class", "id") and any(w.lower() in BOILER_WORDS for w in _NAMES.findall(value)):
            return True
    return False


class Block:
    __slots__ = ("text", "linked", "boiler", "article")

    def __init__(self, text: str, linked: int, boiler: bool, article: bool):
        self.text, self.linked, self.boiler, self.article = text, linked, boiler, article


#: Elements that an end tag or a new item inside them does not close, and those that a new one of their kind closes.
HOLDERS = frozenset("ul ol dl table div section article main nav aside body blockquote".split())
CLOSED_BY_NEXT = frozenset("p li dd dt tr td th option".split())


class Stack:
    """Open elements, each with what it is in: boilerplate, an article element, links around. Names, holders and block
    elements keep their places, so the innermost of a kind is found at once; each element is put and taken once."""

    def __init__(self):
        self.items: list[tuple[str, bool, bool, int]] = []
        self.places: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.blocks: list[int] = []

    def top(self) -> tuple[str, bool, bool, int]:
        return self.items[-1] if self.items else ("", False, False, 0)

    def put(self, name: str, boiler: bool, article: bool, links: int) -> None:
        k = len(self.items)
        self.items.append((name, boiler, article, links))
        self.places.setdefault(name, []).append(k)
        if name in HOLDERS:
            self.holders.append(k)
        if name in BLOCK_ELEMENTS:
            self.blocks.append(k)

    def last(self, name: str) -> int:
        """Place of the innermost element of this name, or -1."""
        at = self.places.get(name)
        return at[-1] if at else -1

    def cut(self, k: int) -> None:
        """Close the element at place k and all in it."""
        while len(self.items) > k:
            name = self.items.pop()[0]
            self.places[name].pop()
            if name in HOLDERS:
                self.holders.pop()
            if name in BLOCK_ELEMENTS:
                self.blocks.pop()

    def open(self, name: str, boiler: bool, article: bool, link: bool) -> None:
        up = self.top()
        self.put(name, up[1] or boiler, up[2] or article, up[3] + link)

    def before(self, name: str) -> None:
        """Close what a start tag closes: the element of its kind that is not outside a holder, or an open paragraph."""
        k = self.last(name)
        if name in CLOSED_BY_NEXT:
            if k >= 0 and (not self.holders or k > self.holders[-1]):
                self.cut(k)
        elif name in BLOCK_ELEMENTS:
            k = self.last("p")
            if k >= len(self.items) - 4 and k >= 0:
                self.cut(k)

    def end(self, name: str) -> None:
        """Close the innermost element of this name; an inline end tag does not close blocks."""
        k = self.last(name)
        if k >= 0 and (name in BLOCK_ELEMENTS or not self.blocks or k > self.blocks[-1]):
            self.cut(k)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with what pass one needs to know of each."""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = links = 0
    boiler = article = False
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, linked, boiler, article))
            parts.clear()
        linked = 0

    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            text = page[pos:]
            pos = n
        else:
            text = page[pos : m.start()]
            pos = m.end()
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in RAW_ELEMENTS:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else n
            if name == "title":
                flush()
            continue
        if name in BLOCK_ELEMENTS:
            flush()
        if name in VOID_ELEMENTS:
            continue
        if not closing:
            stack.before(name)
            if not (attrs.endswith("/") and name not in BLOCK_ELEMENTS):
                stack.open(name, _marks_boilerplate(name, attrs), name in ("article", "main"), name == "a")
        else:
            stack.end(name)
        now = stack.top()
        if (now[1], now[2]) != (boiler, article):
            flush()
            boiler, article = now[1], now[2]
        links = now[3]
    flush()
    return out


def label(blocks: list[Block]) -> list[int]:
    """Pass one and pass two: GOOD or BAD per block."""
    if not blocks:
        return []
    has_article = any(b.article and not b.boiler for b in blocks)
    first = []
    for b in blocks:
        size = len(b.text)
        if b.boiler or has_article and not b.article or b.linked > LINKS * size:
            first.append(BAD)
        elif size < SHORT:
            first.append(OPEN)
        else:
            words = b.text.lower().split()
            stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
            if b.article:  # what stands in the article needs fewer stop words, and without them asks its neighbours
                first.append(GOOD if stops >= STOPS_LOW else OPEN)
            else:
                first.append(GOOD if stops >= STOPS_HIGH else OPEN if stops >= STOPS_LOW else BAD)
    # Decided neighbours of an article's blocks are those of the article that aren't boilerplate by element.
    decided = [k for k, x in enumerate(first) if x != OPEN and not (has_article and (not blocks[k].article or blocks[k].boiler))]
    out, d = list(first), 0
    for k, x in enumerate(first):
        if x != OPEN:
            continue
        while d < len(decided) and decided[d] < k:
            d += 1
        left = decided[d - 1] if d else None
        right = decided[d] if d < len(decided) else None
        if left is None and right is None:
            out[k] = GOOD if blocks[k].article else BAD
        elif left is None or right is not None and right - k < k - left:
            out[k] = first[right]
        elif right is None or k - left < right - k:
            out[k] = first[left]
        else:
            out[k] = max(first[left], first[right])
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks_of(page)
    return " ".join(b.text for b, x in zip(found, label(found), strict=True) if x == GOOD)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without the html column, and the main text of each in a last column (named afresh if pages has out_col)."""
    at = pages.columns.index(html_col)
    keep = [k for k in range(len(pages.columns)) if k != at]
    kind = pages.schema[html_col].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"{html_col} must be a string column")

    def make():
        def fn(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield [part.column(k) for k in keep] + [pa.array([main_text(x.as_py()) for x in part.column(at)], pa.string())]

        return fn

    schema = T.StructType([*(pages.schema.fields[k] for k in keep), T.StructField(fresh(pages, out_col), T.StringType())])
    return map_arrow(pages, make, schema)
