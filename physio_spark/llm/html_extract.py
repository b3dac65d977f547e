"""Main text of web pages by block rules in two passes.

The page is cut into blocks at its block-level tags.  The first pass looks at each block alone: its links,
its length and the density of stop words make it good, bad or, where it is too short to tell, ambiguous.
The second pass gives ambiguous blocks the label of the nearest decided block.

What a page says about itself comes first: containers that are navigation, headers, footers, asides,
forms, notices, adverts or reader comments by tag, role, class or id are out.  All other blocks are judged;
an ``article`` or ``main`` element that holds no less text than the good blocks around it speaks for its blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import widened

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|math|canvas|object|select|button|video|audio)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    # nothing is given back, and a tag that the page's end cuts off ends there: each character is looked at a few times
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?:(?P<rest>(?:(?>\s++[^\s=>\"']++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']*+))?)|/)*+\s*+)>|(?P<loose>[^>]*+)(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
# Names of tags, roles and classes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("aside dialog fieldset footer form head menu nav".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adbox adslot advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted related reply replies "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# What a start tag ends if it was left open, up to the container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"optgroup"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = frozenset(
    # English
    "a about after all also an and are as at be been but by can for from had has have he her his i if in is it its more no not of on one or our out "
    "she so that the their there they this to up was we were what when which who will with would you your "
    # German
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich ihr im in ist man mit nach nicht noch "
    "nur oder sein sich sie sind so um und unter von vor war wenn werden wie wird zu zum zur über "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont "
    "sur un une vous "
    # Spanish
    "al como con cuando de del desde el ella en entre era es esta este ha hay la las le lo los me más muy no nos o para pero por que se ser si sin "
    "sobre son su sus también un una y ya".split()
)
WORD = re.compile(r"[^\W\d_]+")
SHORT, LONG = 70, 200
LOW, HIGH = 0.15, 0.30
LINKED = 0.5


@dataclass
class BlockText:
    """A block's raw pieces, in or outside links, and what the page says about its place."""

    outside: bool
    inside: int
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""
    density: float = 0.0


@dataclass
class _Open:
    name: str
    outside: bool
    inside: int


def _outside(name: str, rest: str, inside: int) -> bool:
    if name in OUTSIDE_TAGS or name == "header" and not inside:
        return True
    if not rest or "=" not in rest and "hidden" not in rest.lower():
        return False
    for key, *values in ATTRIBUTE.findall(rest):
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden":
            return True
        if key == "role" and value in OUTSIDE_ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            words = re.split(r"[^a-z]+", value)
            if not OUTSIDE_NAMES.isdisjoint(words) or "header" in words and not inside:
                return True
    return False


def blocks(html: str) -> list[BlockText]:
    """The page's blocks that hold text, in page order."""
    out: list[BlockText] = []
    stack = [_Open("", False, 0)]
    links, articles, heading = 0, 0, False
    current: BlockText | None = None
    last, linked_from = 0, 0

    def leave(k: int) -> None:
        nonlocal links
        del stack[k:]
        if len(stack) < linked_from:
            links = 0

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            current = BlockText(stack[-1].outside, stack[-1].inside, heading)
            out.append(current)
        piece = unescape(raw) if "&" in raw else raw
        current.pieces.append(piece)
        if links:
            current.linked += len(piece.strip())

    for m in TOKEN.finditer(html):
        add(html[last : m.start()])
        last = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            add(" ")
            continue
        end, rest = bool(m["end"]), m["rest"] or m["loose"] or ""
        if name == "a":
            links, linked_from = 0 if end else 1, len(stack)
            continue
        if name in BLOCK_TAGS:
            current = None
            if name in HEADINGS:
                heading = not end
            if not end or name == "p":  # a paragraph holds no blocks, so any of them ends it and what it left open
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        leave(k)
                        break
                    if stack[k].name in BLOCK_TAGS:
                        break
            if not end and name in SIBLINGS:
                same, holders = SIBLINGS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in holders:
                        break
                    if stack[k].name in same:
                        leave(k)
                        break
        elif not rest or name in VOID_TAGS:
            continue
        if name == "html" or name in VOID_TAGS or name == "p" and end:
            continue
        if name == "body" and not end:
            stack = [s for s in stack if s.name != "head"]
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    links = 0
                    break
            continue
        if stack[-1].name == "head" and name in BLOCK_TAGS:  # a head that nobody closed
            stack.pop()
        top = stack[-1]
        inside = top.inside
        if name in ("article", "main"):
            articles += 1
            inside = articles
        outside = top.outside or _outside(name, rest, inside)
        if name in BLOCK_TAGS or outside:
            stack.append(_Open(name, outside, inside))
            if outside and not top.outside:
                current = None
    add(html[last:])
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in out if b.text]


def _first_pass(block: BlockText, told: bool) -> str:
    """good, bad, or ambiguous (``near`` if it leans to good, ``short`` if it says nothing).

    ``told``: its article speaks for it; few stop words alone do not make it bad then.
    """
    size = len(block.text)
    if block.linked > LINKED * size:
        return "bad"
    if block.heading:
        return "near" if told else "short"
    if size < SHORT:
        return "short"
    if block.density >= HIGH:
        return "good" if size > LONG or told else "near"
    if block.density >= LOW:
        return "good" if told and size > LONG else "near"
    return "near" if told else "bad"


def classify(found: list[BlockText]) -> list[bool]:
    """Whether each block is main text."""
    held = [k for k, b in enumerate(found) if not b.outside]
    around = 0  # text that is good without an article's word
    inside: dict[int, int] = {}  # text of each article outside links
    for k in held:
        block = found[k]
        words = [w.lower() for w in WORD.findall(block.text)]
        block.density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        size = len(block.text)
        if block.inside:
            inside[block.inside] = inside.get(block.inside, 0) + max(0, size - block.linked)
        elif _first_pass(block, False) == "good":
            around += size
    speaks = {k for k, own in inside.items() if own >= around}
    for k in held:
        found[k].label = _first_pass(found[k], found[k].inside in speaks)
    # beside an article that speaks, or in one that does not, a block that nothing decides is no main text
    leans = lambda block: block.inside in speaks or not block.inside and not speaks
    before: dict[int, tuple[int, str]] = {}
    after: dict[int, tuple[int, str]] = {}
    for near, order in ((before, range(len(held))), (after, range(len(held) - 1, -1, -1))):
        seen: dict[int, tuple[int, str]] = {}
        for at in order:
            block = found[held[at]]
            if block.label in ("good", "bad"):
                seen[block.inside] = (at, block.label)
            elif block.inside in seen:
                near[at] = seen[block.inside]
    keep = [False] * len(found)
    for at, k in enumerate(held):
        block = found[k]
        label = block.label
        if label in ("near", "short"):
            sides = [x for x in (before.get(at), after.get(at)) if x]
            labels = {x[1] for x in sides}
            if not labels:  # nothing around it is decided: the page's own word, or the block's own leaning
                label = "good" if block.inside in speaks or label == "near" and leans(block) else "bad"
            elif len(labels) == 1:
                label = "good" if label == "near" and len(sides) == 1 else labels.pop()
            else:
                distance = {x[1]: abs(x[0] - at) for x in sides}
                if distance["good"] == distance["bad"]:
                    label = "good" if block.inside in speaks or label == "near" else "bad"
                else:
                    label = min(distance, key=distance.get)
        keep[k] = label == "good"
    return keep


def main_text(html: str | None) -> str:
    """The page's main blocks, white space inside each turned into one blank, joined by newlines."""
    if not html:
        return ""
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, classify(found), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "main_text") -> DataFrame:
    """All columns of the pages and their main text, in one pass without a shuffle.

    A null or empty page, or one without main text, gives an empty string.  Broken markup (open tags,
    comments or scripts, stray signs) is read as browsers do: what is open ends with its container.
    A column that already has the name ``text`` is refused.
    """
    if text.lower() in (c.lower() for c in pages.columns):
        raise ValueError(f"the pages have a column {text} already")
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    typed = pages.withColumn(html, F.col(html).cast("string"))
    return typed.mapInArrow(run, widened(typed.schema, **{text: "string"}))
