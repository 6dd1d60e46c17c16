"""Main text of web pages by two passes over blocks.

The page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, sidebars and
dialogs (by element or role) and everything inside scripts, styles and the like are taken out first. A box
that only its class or id, or being a form, speaks against is taken out if it adds little: from the outside
in, a box whose good text is more than three times the unlinked text outside such boxes is a wrapper of
the page, and only the boxes inside it are judged further. Boxes of reader comments are never wrappers. First pass: each remaining
block is good, bad, near-good or short from its length, its share of stop words and its share of
link text. Second pass: ambiguous blocks (near-good, short) take the label of the nearest decided
neighbours on both sides if these agree; if they differ, near-good is good and a short block follows
the nearer one.

The page's own word for its article (``article``, else ``main``, or that role) is believed if most of
the text that these rules call good stands inside. Then the first pass is done again: inside, near-good
is good, long text with few stop words near-good, and an ambiguous block is bad only between two bad
ones; outside, good is near-good, near-good short and short bad. If no block inside has the stop words
of the four languages, they say nothing about the page, and its long blocks without links are good.

Broken markup is expected: tags that are never closed, cut-off entities, a page that ends inside a
tag. Everything is linear in the length of the page.

Defined results: NULL or empty html gives an empty text; equal pages give equal texts; an empty table
gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.llm.texts import text_udf

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be but by for from has have he her his in is it its not of on or she that the their they this to was
we were which will with you
aber als am an auch auf aus bei das dem den der des die durch ein eine einen einer er es für hat ich im in ist mit nach
nicht noch nur oder sich sie sind so um und uns von vor war was werden wie wir wird zu zum zur über
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu
que qui sa se ses son sont sur un une vous à
al como con de del el ella en es esta este la las lo los más me no o para pero por que se sin sobre son su sus un una y ya
""".split())

SKIP = frozenset("script style noscript template svg math iframe object embed canvas select option textarea button audio video head title".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
OUTSIDE = frozenset("nav header footer aside dialog menu".split())
BLOCKS = frozenset("""
address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of its kind.
SELF_CLOSING = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
#: Elements that such an implied end does not reach across.
FENCES = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
}
#: Elements of drawings and formulas, where ``/>`` ends an element, and those inside that hold HTML again.
FOREIGN = ("svg", "math")
FOREIGN_HTML = ("foreignobject", "annotation-xml")
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|widget\w*|nav\w*|menu\w*|breadcrumb\w*|"
    r"header|masthead|footer|cookie\w*|consent|gdpr|notice\w*|newsletter|subscri\w*|signup|popup|modal|overlay|share|sharing|social|"
    r"comment\w*|disqus|respond|replies|related|recommend\w*|pagination|pager|copyright|legal|disclaimer|skip|toolbar|search|login)(?:$|[\s_-])",
    re.I,
)
#: Names that tell how a page is laid out or which state it is in, not what a box holds.
LAYOUT = re.compile(r"(?:^|[_-])(?:with|without|has|no|not|show|hide)[_-]|[_-](?:open|opened|closed|enabled|disabled|on|off)$", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus|respond|replies)(?:$|[\s_-])", re.I)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACE = re.compile(r"\s+")

SHORT = 60
LONG = 180
STOP_LOW = 0.08
STOP_HIGH = 0.2
LINKED = 0.4
LINKED_PROSE = 0.2
#: A box holds the page if its good text is more than so many times the unlinked text outside.
WRAPS = 3


@dataclass
class Block:
    """Text pieces of one block, how much of it is link text, and where it stands: ``boxes`` are
    the suspect boxes around it, outermost first, each with its number and whether it holds comments."""

    article: int = 0
    outside: bool = False
    boxes: tuple[tuple[int, bool], ...] = ()
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from ``at``, the position after the tag's end (the page's end if it never ends), whether that is ``/>``."""
    found: dict[str, str] = {}
    n = len(page)
    last = at  # a slash before this belongs to the name or to a value without quotes
    while at < n:
        if page[at] == ">":
            return found, at + 1, at > last and page[at - 1] == "/"
        match = _ATTRIBUTE.match(page, at)
        if match is None or match.end() == at:
            at += 1
            continue
        name = match[1].lower()
        if name not in found:
            found[name] = next((g for g in match.groups()[1:] if g is not None), "")
        at = last = match.end()
        while at < n and page[at] in " \t\n\r\f/":
            at += 1
    return found, n, False


Place = tuple[bool, int, tuple[tuple[int, bool], ...]]


def _marks(tag: str, attributes: dict[str, str], around: Place, number: int) -> Place:
    """Where the text inside the element stands, given the place of the element itself.

    Outside by its kind, level of the article (1 ``main``, 2 ``article``), suspect boxes. An article
    inside a box that only a name speaks against counts as text.
    """
    outside, article, boxes = around
    if not attributes and tag not in OUTSIDE and tag not in ("article", "main", "form"):
        return around
    if tag in ("body", "html"):
        return around
    role = attributes.get("role", "").lower()
    if tag == "article" or role == "article" or attributes.get("itemprop", "") == "articleBody":
        article = 2
    elif tag == "main" or role == "main":
        article = max(article, 1)
    if tag == "article":
        boxes = ()
    if (
        tag in OUTSIDE or role in BOILER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    ):
        return True, article, boxes
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    named = " ".join(n for n in names if not LAYOUT.search(n))
    if tag == "form" or (named and BOILER.search(named)):
        boxes = (*boxes, (number, bool(COMMENTS.search(named))))
    return outside, article, boxes


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; text inside skipped elements is gone already."""
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []  # tag, place of the text inside
    places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag stands in the stack
    open_blocks: list[int] = []  # where block elements stand
    skipping = links = 0
    now = Block()
    at, n = 0, len(page)

    def begin() -> None:
        nonlocal now
        if now.pieces:
            out.append(now)
        outside, article, boxes = stack[-1][1] if stack else (False, 0, ())
        now = Block(article, outside, boxes)

    def add(text: str) -> None:
        if text and not skipping:
            now.pieces.append(text)
            if links:
                now.linked += len(text.strip())

    def nearest(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(index: int) -> None:
        nonlocal skipping, links
        gone = [t for t, _ in stack[index:]]
        del stack[index:]
        for t in gone:
            places[t].pop()
        while open_blocks and open_blocks[-1] >= index:
            open_blocks.pop()
        skipping -= sum(t in SKIP for t in gone)
        links -= gone.count("a")
        if any(t in BLOCKS for t in gone):
            begin()

    while at < n:
        match = _TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at:match.start()])
        found = match[0]
        at = match.end()
        if found == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
        elif found == "<![CDATA[":
            end = page.find("]]>", at)
            at = n if end < 0 else end + 3
        elif match[2] is None:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        elif match[1]:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            tag = match[2].lower()
            index = nearest((tag,))
            if index >= 0:
                close(index)
            elif tag in BLOCKS:
                begin()
        else:
            tag = match[2].lower()
            attributes, at, ended_here = _attributes(page, at)
            if tag == "br":
                add(" ")
                continue
            if tag in VOID:
                if tag in BLOCKS:
                    begin()
                continue
            if ended_here and (tag in FOREIGN or nearest(FOREIGN) > nearest(FOREIGN_HTML)):
                continue
            ended = SELF_CLOSING.get(tag)
            if ended and tag != "p":
                index = nearest(ended)
                if index > nearest(FENCES[tag]):
                    close(index)
            elif tag in BLOCKS and open_blocks and stack[open_blocks[-1]][0] == "p":
                close(open_blocks[-1])
            around = stack[-1][1] if stack else (False, 0, ())
            places[tag].append(len(stack))
            if tag in BLOCKS:
                open_blocks.append(len(stack))
            stack.append((tag, _marks(tag, attributes, around, at)))
            skipping += tag in SKIP
            links += tag == "a"
            if tag in BLOCKS:
                begin()
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(page, at)
                inner = page[at:end.start()] if end else page[at:]
                add(inner)
                at = end.start() if end else n
    if now.pieces:
        out.append(now)
    for block in out:
        block.text = _SPACE.sub(" ", html.unescape("".join(block.pieces))).strip()
    return [b for b in out if b.text]


def _stop_share(block: Block) -> float:
    words = block.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def _link_share(block: Block) -> float:
    return min(1.0, block.linked / len(block.text))


def first_pass(block: Block) -> str:
    """good, bad, near or short."""
    share = _link_share(block)
    if share > LINKED:
        return "bad"
    if len(block.text) < SHORT:
        return "bad" if share > LINKED_PROSE else "short"
    stops = _stop_share(block)
    if stops >= STOP_HIGH:
        return "good" if len(block.text) > LONG else "near"
    if stops >= STOP_LOW:
        return "near"
    return "short" if share <= LINKED_PROSE else "bad"


def moved(block: Block, label: str, inside: bool, told: bool) -> str:
    """The label with the article as a prior. ``told``: stop words tell something about this page."""
    if not inside:
        return {"good": "near", "near": "short"}.get(label, "bad")
    share = _link_share(block)
    if share > LINKED:
        return "bad"
    if len(block.text) < SHORT:
        return "short"
    if label in ("good", "near") or not told:
        return "good"
    return "near" if share <= LINKED_PROSE else "bad"


def _nearest(labels: list[str]) -> list[tuple[str, int] | None]:
    """For each block the decided block before it: label and distance."""
    out: list[tuple[str, int] | None] = []
    last = None
    for i, label in enumerate(labels):
        out.append((last[0], i - last[1]) if last else None)
        if label in ("good", "bad"):
            last = (label, i)
    return out


def second_pass(labels: list[str], named: bool | list[bool]) -> list[str]:
    """Final labels: good or bad. Without any decided block the ambiguous ones are all there is: good.

    ``named``: the block (or every block) stands in the page's article.
    """
    inside = [named] * len(labels) if isinstance(named, bool) else named
    before = _nearest(labels)
    after = _nearest(labels[::-1])[::-1]
    out = []
    for label, a, b, named in zip(labels, before, after, inside, strict=True):
        sides = {x[0] for x in (a, b) if x}
        if label in ("good", "bad"):
            out.append(label)
        elif len(sides) < 2:
            out.append("good" if named and not (a and b) else next(iter(sides), "good"))
        elif label == "near" or named:
            out.append("good")
        else:
            out.append(a[0] if a[1] <= b[1] else b[0])
    return out


def _region(found: list[Block], labels: list[str]) -> list[bool] | None:
    """Which blocks stand in the page's article, if most of the good text does (else None)."""
    good = [len(b.text) if label == "good" else 0 for b, label in zip(found, second_pass(labels, False), strict=True)]
    if not any(good):
        good = [len(b.text) if _link_share(b) <= LINKED else 0 for b in found]
    for level in (2, 1):
        inside = [b.article >= level for b in found]
        if 2 * sum(n for n, at in zip(good, inside, strict=True) if at) > sum(good):
            return inside
    return None


def _unwrapped(found: list[Block]) -> list[Block]:
    """The blocks outside suspect boxes, once boxes that hold the page count as its wrappers."""
    if not any(b.boxes for b in found):
        return found
    plain = [len(b.text) if _link_share(b) <= LINKED else 0 for b in found]
    weights = [n if first_pass(b) == "good" else 0 for b, n in zip(found, plain, strict=True)]
    if not any(weights):
        weights = plain
    places = [b.boxes for b in found]
    while True:
        free = sum(n for n, p in zip(plain, places, strict=True) if not p)
        held: dict[tuple[int, bool], int] = {}
        for w, p in zip(weights, places, strict=True):
            if p:
                held[p[0]] = held.get(p[0], 0) + w
        wrappers = {box for box, w in held.items() if w > WRAPS * free and not box[1]}
        if not wrappers:
            return [b for b, p in zip(found, places, strict=True) if not p]
        most = max(wrappers, key=lambda box: (held[box], -box[0]))
        places = [p[1:] if p and p[0] == most else p for p in places]


def main_text(page: str | None) -> str:
    """The kept blocks, joined by an empty line."""
    found = _unwrapped([b for b in blocks(page or "") if not b.outside])
    labels = [first_pass(b) for b in found]
    inside = _region(found, labels)
    if inside:
        told = any(at and len(b.text) >= SHORT and _stop_share(b) >= STOP_LOW for b, at in zip(found, inside, strict=True))
        labels = [moved(b, label, at, told) for b, label, at in zip(found, labels, inside, strict=True)]
    final = second_pass(labels, inside or False)
    return "\n\n".join(b.text for b, label in zip(found, final, strict=True) if label == "good")


def _kernel():
    def run(texts: list) -> pd.DataFrame:
        return pd.DataFrame({"text": pd.Series([main_text(t) for t in texts], dtype=object)})

    return run


def main_text_column(page: str | Column = "html") -> Column:
    return text_udf(_kernel, "text string")(page)["text"]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; other columns are ignored."""
    text = pages.select("page_id", "url", main_text_column(F.col("html")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
