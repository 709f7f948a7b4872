"""Main text of web pages by two-pass block rules.

A page becomes blocks of text with their stop-word density, length and link
density. First pass: long blocks with many stop words are text; blocks made of
links, or inside navigation, notices, adverts and the like, are not; the rest
stay open. Second pass: open blocks take the label of the nearest decided
blocks of their region. The densities decide alike whatever the elements are
called; an ``article`` or ``main`` element only sets a region apart once the
first pass has found text in it. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

LONG, STOPS, LINKS = 80, 0.25, 0.4

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on with as was be by this are at from or an not have had but which they you
    der die das und ist von den mit zu ein eine nicht auf für im dem des sich auch als an er sie es wie bei
    le la les de des et un une est que qui dans pour pas sur avec par au en il elle ce se ne plus
    el los las del y que en un una es por con para no se su al lo como más o pero""".split()
)
# Element names by role.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot
    th thead tr ul""".split()
)
DROPPED = frozenset(
    """head script style noscript template svg math iframe object embed applet canvas audio video select option
    textarea button input label map""".split()
)
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements an end tag of the inner ones does not reach beyond.
BARRIERS = frozenset("article main body table nav div section".split())
INNER = frozenset("p li td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th")} | {
    k: ("td", "th") for k in ("td", "th")
}
MARKS = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo|promos|promotions?|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|cookies?"
    r"|consent|gdpr|notices?|alert|popup|modal|overlay|share|sharing|social|related|recommended|comments?|commentlist|disqus"
    r"|repl(?:y|ies)|footer|masthead|topbar|toolbar|newsletter|subscribe|login|signup|pagination|pager|widget)",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
#: Parts of a class that say what a wrapper has around it, not what it is.
#: Marks of elements that are never the page's text, however much they hold.
NEVER = re.compile(r"comments?|commentlist|disqus|repl(?:y|ies)|cookies?|consent|gdpr", re.I)
LAYOUT = frozenset("has with no without".split())
WORDS = re.compile(r"[^\W\d_]+")


def marks_in(value: str) -> list[str]:
    """Marks among the words of a class or id, in tokens that are not about the layout."""
    tokens = [[x for x in re.split("[_-]+", t) if x] for t in value.split()]
    return [x for t in tokens if not LAYOUT.intersection(map(str.lower, t)) for x in t if MARKS.fullmatch(x)]


@dataclass
class Block:
    text: str
    linked: int
    main: bool
    aside: bool
    heading: bool = False
    marks: tuple[int, ...] = ()


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str, int]] = []
        #: Where in ``open`` each name stands, and where what ends a paragraph's reach; marks of the open elements.
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.held: list[int] = []
        #: Elements marked by class or id, and forms: (is a form, may be the page's text, holds a main element).
        self.marks: list[list[bool]] = []
        self.n = {"drop": 0, "aside": 0, "main": 0}
        self.parts: list[str] = []
        self.linked = 0
        self.link = False

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                heading = bool(self.open) and self.open[-1][0] in HEADINGS
                linked = min(self.linked, len(text))
                self.blocks.append(Block(text, linked, self.n["main"] > 0, self.n["aside"] > 0, heading, tuple(self.held)))
            self.parts, self.linked = [], 0

    def push(self, tag: str, kind: str, mark: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BARRIERS:
            self.barriers.append(len(self.open))
        if mark >= 0:
            self.held.append(mark)
        if kind:
            self.n[kind] += 1
        self.open.append((tag, kind, mark))

    def pop_to(self, at: int) -> None:
        for tag, kind, mark in reversed(self.open[at:]):
            self.places[tag].pop()
            if tag in BARRIERS:
                self.barriers.pop()
            if mark >= 0:
                self.held.pop()
            if kind:
                self.n[kind] -= 1
        del self.open[at:]

    def kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in DROPPED:
            return "drop"
        if tag in BOILERPLATE or (tag == "header" and not self.n["main"]):
            return "aside"
        if tag not in ("html", "body"):
            for name, value in attrs:
                if value and name == "role" and value.lower() in ROLES:
                    return "aside"
                if value is None and name == "hidden" or name == "aria-hidden" and value == "true":
                    return "drop"
        if tag in MAIN or any(n in ("role", "itemprop") and v in ("main", "articleBody") for n, v in attrs):
            return "main"
        return ""

    def has_marks(self, tag: str, attrs: list[tuple[str, str | None]]) -> list[str]:
        if tag in ("html", "body"):
            return []
        return [m for name, value in attrs if value and name in ("class", "id") for m in marks_in(value)]

    def mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        found = self.has_marks(tag, attrs)
        if not found and tag != "form":
            return -1
        self.marks.append([tag == "form", not any(map(NEVER.fullmatch, found)), False])
        return len(self.marks) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.cut()
            return
        kind = self.kind(tag, attrs)
        if tag == "body" and self.n["drop"]:  # a head that was never closed
            self.cut()
            self.pop_to(0)
        is_main = kind == "main" and tag != "article"
        if tag in BLOCKS or kind or self.has_marks(tag, attrs):
            self.cut()
            implied = CLOSES.get(tag, ()) + (("p",) if tag in BLOCKS else ())
            for i in range(len(self.open) - 1, max(-1, len(self.open) - 4), -1):
                if self.open[i][0] in implied:
                    self.pop_to(i)
                    break
            self.push(tag, kind, self.mark(tag, attrs))
            if is_main:
                for m in self.held:
                    self.marks[m][2] = True
        elif tag == "a":
            self.link = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in BLOCKS:
            self.cut()
        at = self.places.get(tag)
        if at and not (tag in INNER and self.barriers and self.barriers[-1] > at[-1]):
            self.cut()
            self.pop_to(at[-1])

    def handle_data(self, data: str) -> None:
        if not self.n["drop"]:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    return settled(parser.blocks, parser.marks)


def rich(block: Block) -> bool:
    """Long, with many stop words and few links."""
    words = WORDS.findall(block.text.lower()) if len(block.text) >= LONG else []
    return bool(words) and sum(w in STOP_WORDS for w in words) >= STOPS * len(words) and block.linked <= LINKS * len(block.text)


def settled(blocks: list[Block], marks: list[list[bool]]) -> list[Block]:
    """Blocks with their marked elements decided: such an element is an aside, and what a form holds is left out.

    On a page whose article is not clear otherwise, an element that holds a main
    element or over half of the page's rich text is a wrapper and decides nothing.
    """
    if not any(b.marks for b in blocks):
        return blocks
    texts = [b for b in blocks if not b.aside and rich(b)]
    wrappers: set[int] = set()
    if not any(b.main and not b.marks for b in texts):
        held = dict.fromkeys(range(len(marks)), 0)
        for b in texts:
            for m in b.marks:
                held[m] += len(b.text)
        half = sum(len(b.text) for b in texts) / 2
        wrappers = {m for m, (_, may, main) in enumerate(marks) if may and (main or held[m] > half)}
    out = []
    for b in blocks:
        left = [m for m in b.marks if m not in wrappers]
        if not any(marks[m][0] for m in left):
            b.aside = b.aside or bool(left)
            out.append(b)
    return out


def first_pass(block: Block) -> bool | None:
    """True: text; False: not; None: open. Densities decide alike wherever a block stands; an aside is never text."""
    if block.aside:
        return False
    links = block.linked / len(block.text)
    if links > LINKS:
        return False
    if rich(block):
        return True
    words = WORDS.findall(block.text.lower()) if links and len(block.text) >= LONG else []
    if words and sum(w in STOP_WORDS for w in words) < STOPS / 3 * len(words):
        return False
    return None


def labels(blocks: list[Block]) -> list[bool]:
    """The final label of every block, in order.

    Where the first pass finds text inside a main element, what lies outside is
    not the article. A main element without any decides nothing. Open blocks
    take the label of the nearest decided block of their region, headings at
    equal distance that of the block below; asides are no neighbours.
    """
    first = [first_pass(b) for b in blocks]
    confirmed = any(v and b.main for b, v in zip(blocks, first, strict=True))
    if confirmed or all(b.main or b.aside for b in blocks):
        region = [b.main for b in blocks]
    else:
        region = [True] * len(blocks)
    first = [v if r else False for v, r in zip(first, region, strict=True)]
    out = [bool(v) for v in first]
    decided = [i for i, b in enumerate(blocks) if region[i] and not b.aside and first[i] is not None]
    for i, b in enumerate(blocks):
        if first[i] is not None:
            continue
        j = bisect_left(decided, i)
        left, right = decided[j - 1] if j else None, decided[j] if j < len(decided) else None
        if left is None and right is None:
            out[i] = True  # nothing tells against it
        elif left is None or right is None:
            out[i] = bool(first[right if left is None else left])
        else:
            nearer = right if right - i < i - left or (b.heading and right - i == i - left) else left
            out[i] = bool(first[nearer])
    return out


def main_text(html: str | None) -> str:
    """Blocks labelled as text, in page order, one to a line."""
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, keep in zip(blocks, labels(blocks), strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty pages give an empty text; ids and urls may be null or
    repeated; an empty table gives no rows; other columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    bounded_batches(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
