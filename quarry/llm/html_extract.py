"""Main-text extraction from HTML by two passes of block rules.

A page is cut into blocks at block-level tags.  Pass one labels each block from its
stop-word density, length and link density: long, dense blocks with few links are text,
blocks full of links or long ones without function words are not, all others stay open.
Pass two gives open blocks the label of their nearest decided neighbours.

Markup adds to that in two ways.  Menus, footers, sidebars, forms, adverts, notices, hidden
elements and comment lists, told by tag or by words of class, id and role, are never
text.  ``article`` and ``main`` are a prior: inside them a block needs less
density, neighbours are those of the same element, and a block that they leave open is
text.  Where hardly any function word of the four languages occurs, length and link
density decide alone.

Defined cases: null, empty and markup-only pages give an empty text; unclosed, crossed and
cut-off tags are tolerated (an element ends with its parent, a paragraph at the next block,
an item at the next item); character references are decoded once, after the markup is gone;
texts have no length limit and take time in proportion; repeated rows are extracted each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

# Tags.
RAW = frozenset("script style textarea title noscript iframe svg template object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never text, and those that are not unless an article lies inside.
GONE_TAGS = frozenset("nav footer aside menu dialog select button".split())
SHUT_TAGS = frozenset("form fieldset".split())
CONTAINERS = frozenset({"article", "main"})
#: Tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Tags that end an open element of the listed kinds, as long as none of the last ones lies between.
ENDS_ITEM = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words of class, id and role attributes.
#: Never text, whatever lies inside.
GONE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsors sponsored promo promos promotion promotions promoted
    cookie cookies consent gdpr notice notices popup popups modal newsletter subscribe signup breadcrumb breadcrumbs related recommended recommendations
    share sharing social comment comments commentlist disqus reply replies respond login pagination pager alertdialog""".split()
)
#: Parts of a page beside its text; an article inside them is text all the same.
SHUT_WORDS = frozenset("nav navbar navigation menu menus menubar sidebar sidebars footer masthead complementary contentinfo topbar".split())
#: Weaker ones: inside an article the block rules decide.
WEAK_WORDS = frozenset("header banner search tags toolbar widget widgets".split())
#: Words that make a state or a part of the article of the others.
STATES = frozenset("has with without no open closed enabled disabled layout".split())
OWN_PARTS = frozenset("entry post article page story content section title".split())
# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his are this at from but have an they which you were her all
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so dass kann wird bei
    le la les de des et en un une du que est pour qui dans par sur au plus ne se pas avec ce il sont ou
    el los las y del se por con una su para al lo como más pero sus o este sí porque esta entre cuando muy sin sobre""".split()
)

_OPEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
_UNTIL = re.compile(r">|=\s*[\"']")
_MARKED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"\w+")

SHORT, LONG = 70, 120
STOPS_LOW, STOPS_HIGH = 0.10, 0.20
#: Share of function words in a page's longer blocks under which its language is unknown.
STOPS_KNOWN = 0.03
LINKS_HIGH, LINKS_ALL = 0.35, 0.8
#: Blocks of links in a row that are a menu, also inside an article.
MENU = 3

OUT, IN, WEAK, SHUT, GONE = range(5)
TEXT, BOILER, NEAR, FAR = range(4)


def marks_of(attributes: str) -> int:
    """GONE, SHUT, WEAK or OUT, as class, id and role say."""
    worst = OUT
    for groups in _MARKED.findall(attributes):
        for token in "".join(groups).split():
            words = {w.lower() for w in _PARTS.findall(token)}
            if words & STATES:
                continue
            if words & GONE_WORDS:
                return GONE
            if words & SHUT_WORDS:
                worst = SHUT
            elif worst == OUT and words & WEAK_WORDS and not words & OWN_PARTS:
                worst = WEAK
    return worst


class _Block:
    __slots__ = ("heading", "inside", "link_chars", "parts", "zone")

    def __init__(self, zone: int, inside: int, heading: bool):
        self.parts: list[str] = []
        self.link_chars = 0
        self.zone, self.inside, self.heading = zone, inside, heading

    def text(self) -> str:
        return " ".join("".join(map(html.unescape, self.parts)).split())


def _tag_end(source: str, at: int, missing: set[str]) -> tuple[int, int]:
    """Where the attributes of a tag end and where the text goes on; quoted values may hold ``>``."""
    look = at
    while True:
        m = _UNTIL.search(source, look)
        if m is None:
            return len(source), len(source)
        if m[0] == ">":
            return m.start(), m.end()
        quote = m[0][-1]
        close = -1 if quote in missing else source.find(quote, m.end())
        if close < 0:
            missing.add(quote)
        look = m.end() if close < 0 else close + 1


def _zone_of(name: str, attributes: str, zone: int) -> int:
    """The zone inside an element that opens in ``zone``."""
    if zone == GONE or name in GONE_TAGS or _HIDDEN.search(attributes):
        return GONE
    marks = marks_of(attributes) if attributes and name not in HEADINGS and name not in ("body", "html") else OUT
    if name in CONTAINERS:
        own = {w.lower() for g in _MARKED.findall(attributes) for t in "".join(g).split()[:1] for w in _PARTS.findall(t)}
        return GONE if marks == GONE and own & GONE_WORDS else IN
    if marks == GONE:
        return GONE
    if marks == SHUT or name in SHUT_TAGS:
        return SHUT
    if marks == WEAK or name == "header":
        return zone if zone == IN and name == "header" else WEAK if zone in (IN, WEAK) else SHUT
    return zone


def blocks_of(source: str) -> list[_Block]:
    """The blocks of a page in order, with what their open elements say."""
    found: list[_Block] = []
    open_tags: list[tuple[str, int, int]] = []  # name, zone and container outside of it
    where: defaultdict[str, list[int]] = defaultdict(list)  # places of each name in it; "" those of blocks
    zone, inside, containers, links, at, size = OUT, 0, 0, 0, 0, len(source)
    block, missing, unclosed = _Block(zone, inside, False), set(), set()

    def end_block(heading: bool = False) -> None:
        nonlocal block
        if block.parts:
            found.append(block)
        block = _Block(zone, inside, heading)

    def push(name: str) -> None:
        where[name].append(len(open_tags))
        if name not in INLINE:
            where[""].append(len(open_tags))
        open_tags.append((name, zone, inside))

    def last(names) -> int:
        return max((where[n][-1] for n in names if where[n]), default=-1)

    def close(k: int) -> None:
        """End the element at ``k`` and all that is open inside it."""
        nonlocal zone, inside
        _, zone, inside = open_tags[k]
        for name, _, _ in open_tags[k:]:
            where[name].pop()
            if name not in INLINE:
                where[""].pop()
        del open_tags[k:]

    def close_item(kinds, until) -> None:
        k = last(kinds)
        if k > last(until):
            close(k)

    def add(text: str) -> None:
        if block.zone == zone:  # a hidden inline element leaves its block as it is
            block.parts.append(text)
            if links:
                block.link_chars += len(text.strip())

    while at < size:
        hit = source.find("<", at)
        if hit < 0:
            hit = size
        if hit > at:
            add(source[at:hit])
        if hit == size:
            break
        m = _OPEN.match(source, hit)
        if m is None:  # a lone "<" is text
            add("<")
            at = hit + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        closing, name = bool(m[1]), m[2].lower()
        stop, at = _tag_end(source, at, missing)
        attributes = source[m.end() : stop]
        if closing:
            if name == "a":
                links = 0
            k = last((name,))
            if k > (last(("",)) if name in INLINE else -1):  # an inline end tag ends nothing across blocks
                close(k)
            if name not in INLINE and name not in VOID:
                links = 0
                end_block()
            continue
        if name in RAW:
            if name == "svg" and attributes.endswith("/"):
                continue
            end = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
            if end:
                at = end.end()
            elif name == "title":
                unclosed.add(name)
            else:
                at = size
            add(" ")
        elif name == "br":
            add(" ")
        elif name in INLINE:
            links = links or name == "a"
            if attributes and name not in VOID and not attributes.endswith("/") and _HIDDEN.search(attributes):
                push(name)
                zone = GONE
        elif name in VOID:
            if name == "hr":
                end_block()
        else:
            if name in ENDS_P:
                close_item({"p"}, {"td", "th", "table", "button"})
            elif name in ENDS_ITEM:
                close_item(*ENDS_ITEM[name])
            push(name)
            zone = _zone_of(name, attributes, zone)
            if name in CONTAINERS and zone == IN:
                containers += 1
                inside = containers
            links = 0
            end_block(name in HEADINGS)
    end_block()
    return found


def _size(text: str) -> int:
    """Length of a text; characters of scripts without spaces count three."""
    return len(text) if text.isascii() else len(text) + 2 * sum(c >= "⺀" for c in text)


def _first_label(b: _Block, text: str, stops: float, known: bool, menu: bool) -> int:
    """TEXT or BOILER; NEAR where one neighbour is enough to be text, FAR where all must be."""
    links, size = b.link_chars / len(text), _size(text)
    if b.zone in (SHUT, GONE) or menu:
        return BOILER
    dense = not known or stops >= STOPS_HIGH
    if size >= LONG and dense and links <= LINKS_HIGH:
        return TEXT
    if b.zone == IN:
        return TEXT if size >= LONG and stops >= STOPS_LOW and links <= LINKS_ALL else NEAR
    if links > LINKS_HIGH or text.startswith("©"):
        return BOILER
    if b.zone == WEAK or size < SHORT:
        return FAR
    return NEAR if stops >= STOPS_LOW or not known else BOILER


def _nearest(found: list[tuple[_Block, str]], labels: list[int], order) -> list[int | None]:
    """The decided label met last in ``order`` before each block.

    Blocks look to those of the same container, where what markup takes out does not count.
    """
    out: list[int | None] = [None] * len(labels)
    last: dict[int, int] = {}
    for i in order:
        b = found[i][0]
        out[i] = last.get(b.inside)
        if labels[i] in (TEXT, BOILER) and not (b.inside and b.zone in (SHUT, GONE)):
            last[b.inside] = labels[i]
    return out


def extract(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    found = [(b, text) for b in blocks_of(source) if (text := b.text())]
    stops, function, words_of_page = [], 0, 0
    for b, text in found:
        words = _WORD.findall(text.lower()) if b.zone not in (SHUT, GONE) else []
        hits = sum(map(STOP_WORDS.__contains__, words))
        stops.append(hits / max(1, len(words)))
        if len(text) >= SHORT:
            function, words_of_page = function + hits, words_of_page + len(words)
    known = function >= STOPS_KNOWN * words_of_page
    full = [b.zone not in (SHUT, GONE) and b.link_chars > LINKS_ALL * len(text) for b, text in found]
    run, menu = 0, [False] * len(found)
    for i, f in enumerate([*full, False]):
        if f:
            run += 1
            continue
        if run >= MENU:
            menu[i - run : i] = [True] * run
        run = 0
    labels = [_first_label(b, text, s, known, m) for (b, text), s, m in zip(found, stops, menu)]
    before, after = _nearest(found, labels, range(len(found))), _nearest(found, labels, range(len(found) - 1, -1, -1))
    keep = []
    for (b, text), label, x, y in zip(found, labels, before, after):
        votes = [v for v in (x, y) if v is not None]
        if label not in (TEXT, BOILER):
            if b.zone == IN:  # the container decides where its blocks do not agree
                label = BOILER if votes == [BOILER, BOILER] else TEXT
            elif b.heading and y is not None:  # a heading goes with what follows
                label = y
            elif label == NEAR:
                label = TEXT if TEXT in votes or not votes else BOILER
            else:
                label = TEXT if BOILER not in votes and (votes or b.zone == OUT or b.inside) else BOILER
        if label == TEXT:
            keep.append(text)
    return "\n".join(keep)


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``."""
    prepare(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(page, url, source).mapInArrow(run, f"page_id {kinds[page]}, url {kinds[url]}, text string, n_chars long")
