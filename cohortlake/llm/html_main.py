"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into text blocks at block-level tags. A linear classifier gives each block a score from its length, share
of link text, and the elements and names around it; a positive score is the capacity from the content terminal, a negative
one that to the boilerplate terminal. Smoothness edges join neighbouring blocks, stronger under one parent (adjacency), and
each block to the last one in the same container (DOM proximity). The minimum cut, found by maximum flow, labels the blocks
at the least total of classifier cost and cut edges. One page is a problem of its own: one pass, no shuffle.

A class, id or role made up of side names and words of layout alone (``cookie-notice``, ``sidebar-left``) weighs heavily; a
side name beside other words (``social-history``), a name that may also be a topic (``legal``, ``share``), and hidden elements
weigh little: length, links and the blocks around decide. Fallback text (noscript, object, iframe) is text like any other.

An element that its tag or name makes a side part is a wrapper all the same if it holds an article or main element and half
of the page's text, or if nearly all of the text is in it, in paragraphs, and nothing outside looks like content (a page within one
form, ``class="widget-container"``): it then weighs nothing. What was written by readers is never a wrapper of that second kind.
Paragraphs of some length in an article's own header belong to it.

Nulls and edges: a null, empty or text-free page gives an empty text; null ids and urls are kept; repeated rows are
extracted each; other columns are ignored; unclosed and misnested tags are closed by their parents; an empty table gives
no rows. A page's memory follows its own length.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: fixed values: tag and name lists
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIDE_TAGS = frozenset("aside button dialog footer form head menu nav".split())
SIDE_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted recommended replies respond sidebar signup sponsor sponsored subscribe subscription toolbar widget".split()
)
TOPIC_NAMES = frozenset("alert disclaimer discussion gdpr legal promotion related reply search share sharing social".split())
LAYOUT_NAMES = frozenset("area bar bottom box btn button buttons card col column container desktop fixed global group header inner items left links list main mobile module open outer page panel right row section site slot sticky top unit wrap wrapper".split())
HEAD_NAMES = frozenset("header masthead topbar".split())
READER_NAMES = frozenset("comment comments discussion replies reply respond".split())
MAIN_NAMES = frozenset("article body content entry main post story text".split())
RAW = "script|style|title|textarea|template|svg|canvas|select"

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<svg(?:\s[^>]*)?/>|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-z][^>]*>", re.S | re.I)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_LETTERS = re.compile(r"[a-z]+")
SIDE, HEAD, ARTICLE, MAIN, LINK, HINT = 1, 2, 4, 8, 16, 32


@dataclass
class TextBlock:
    text: str
    tag: str
    flags: int
    linked: int
    #: numbers of the parent element and of the container around it
    parent: int
    container: int
    #: numbers of the elements around it that are side parts, or perhaps, by tag or name
    sides: tuple[int, ...] = ()


@dataclass
class SidePart:
    """An element that looks like a side part (SIDE) or perhaps one (HINT): may it be a wrapper, does it hold an article, and
    what text is in it."""

    flag: int
    can_wrap: bool
    holds_article: bool = False
    size: int = 0
    paragraphs: int = 0


def _flags(tag: str, attributes: str) -> int:
    out = SIDE if tag in SIDE_TAGS else HEAD if tag == "header" else ARTICLE if tag == "article" else MAIN if tag == "main" else LINK if tag == "a" else 0
    if attributes:
        for m in _NAMES.finditer(attributes):
            for value in (m[1] or m[2] or m[3] or "").lower().split():
                names = _LETTERS.findall(value)
                if not SIDE_NAMES.isdisjoint(names):
                    out |= SIDE if all(x in SIDE_NAMES or x in TOPIC_NAMES or x in LAYOUT_NAMES for x in names) else HINT
                elif not TOPIC_NAMES.isdisjoint(names):
                    out |= HINT
                elif not HEAD_NAMES.isdisjoint(names):
                    out |= HEAD
                elif not MAIN_NAMES.isdisjoint(names):
                    out |= MAIN
        if _HIDDEN.search(attributes):
            out |= HINT
    if tag in ("body", "html"):  # names of the whole page tell nothing of a part
        out &= ~(SIDE | HEAD | MAIN | HINT)
    return out


def text_blocks(page: str) -> list[TextBlock]:
    """The text blocks of a page in order, character references decoded and white space made single."""
    out: list[TextBlock] = []
    # tag, flags with those around but for SIDE and HINT, number, container, numbers of the side parts around
    stack: list[tuple[str, int, int, int, tuple[int, ...]]] = [("", 0, 0, 0, ())]
    parts_aside: dict[int, SidePart] = {}
    parts: list[str] = []
    linked: list[str] = []
    serial = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = next(x for x in reversed(stack) if x[0] in BLOCK_TAGS or not x[0])
                out.append(TextBlock(text, own[0], own[1], len(" ".join("".join(linked).split())), own[2], own[3], own[4]))
            parts.clear()
            linked.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if stack[-1][1] & LINK:
                linked.append(text)
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in BLOCK_TAGS:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        elif tag in SELF_CLOSING:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SELF_CLOSING[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div", "section", "article"):
                    break
        if tag not in VOID_TAGS and not m[4].endswith("/"):
            serial += 1
            above = stack[-1]
            container = above[2] if tag in BLOCK_TAGS else above[3]
            flags, sides = _flags(tag, m[4]), above[4]
            if flags & (SIDE | HINT):
                readers = not READER_NAMES.isdisjoint(_LETTERS.findall(m[4].lower()))
                parts_aside[serial] = SidePart(flags & (SIDE | HINT), not readers and (tag == "form" or tag not in SIDE_TAGS))
                sides = (*sides, serial)
            elif tag in ("article", "main"):
                for s in sides:
                    parts_aside[s].holds_article = True
            stack.append((tag, above[1] | (flags & ~(SIDE | HINT)), serial, container, sides))
    if at < len(page):
        parts.append(page[at:])
    flush()
    _mark_sides(out, parts_aside)
    return out


def _mark_sides(blocks: list[TextBlock], aside: dict[int, SidePart]) -> None:
    """SIDE and HINT for the blocks in such parts that are no wrappers."""
    total = 0
    for b in blocks:
        size = max(0, len(b.text) - b.linked)
        total += size
        for s in b.sides:
            aside[s].size += size
            aside[s].paragraphs += b.tag == "p"
    wrappers = {s for s, x in aside.items() if x.holds_article and 2 * x.size >= total}
    for s, x in aside.items():
        if s not in wrappers and x.can_wrap and x.paragraphs > 1 and x.size >= 200 and 10 * x.size >= 9 * total and not any(score(b) > 0 for b in blocks if s not in b.sides and not b.sides):
            wrappers.add(s)
    for b in blocks:
        for s in b.sides:
            if s not in wrappers:
                b.flags |= aside[s].flag


def score(block: TextBlock) -> float:
    """Above 0: the block looks like content."""
    words = block.text.count(" ") + 1
    out = 0.7 * math.log2(1 + words) - 1.8 - 5 * block.linked / max(1, len(block.text))
    if block.tag == "p":
        out += 0.8
    elif block.tag in ("td", "th"):  # short by nature
        out += 1
    elif block.tag in ("li", "dt"):
        out -= 0.4
    heading = len(block.tag) == 2 and block.tag[0] == "h" and block.tag[1].isdigit()
    if block.flags & ARTICLE:
        out += 5
    if block.flags & MAIN:
        out += 2
    if block.flags & HEAD:
        own = block.flags & ARTICLE and (heading or block.tag == "p" and words >= 8)  # a title, a standfirst
        out -= 1 if own else 12
    if block.flags & SIDE:
        out -= 14
    if block.flags & HINT:
        out -= 3
    return out


def edges(blocks: list[TextBlock]) -> dict[tuple[int, int], float]:
    """Smoothness between neighbours, and between a block and the last one in its container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out[i - 1, i] = 0.5 + 0.7 * (blocks[i - 1].parent == b.parent) + 0.3 * (blocks[i - 1].container == b.container)
        j = last.get(b.container)
        if j is not None:
            out[j, i] = out.get((j, i), 0) + 0.5
        last[b.container] = i
    return out


def min_cut(scores: list[float], smooth: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the content terminal in a minimum cut; of equal cuts the one with the least content.

    Maximum flow in phases: levels from all nodes with flow to give, then every shortest path of the phase.
    """
    n = len(scores)
    spare = list(scores)  # left to the content terminal (above 0) or to the other (below 0)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in smooth.items():
        room[i][j] = room[i].get(j, 0) + w
        room[j][i] = room[j].get(i, 0) + w
    near = [list(x) for x in room]
    while True:
        level = [0 if x > 1e-9 else -1 for x in spare]
        givers = front = [i for i in range(n) if level[i] == 0]
        met = False
        while front and not met:
            reached = []
            for i in front:
                for j in near[i]:
                    if level[j] < 0 and room[i][j] > 1e-9:
                        level[j] = level[i] + 1
                        reached.append(j)
                        met = met or spare[j] < -1e-9
            front = reached
        if not met:
            return [x >= 0 for x in level]
        tried = [0] * n
        for giver in givers:
            path = [giver]
            while path and spare[giver] > 1e-9:
                i = path[-1]
                if spare[i] < -1e-9:
                    flow = min(spare[giver], -spare[i], *(room[a][b] for a, b in zip(path, path[1:])))
                    spare[giver] -= flow
                    spare[i] += flow
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] += flow
                    path = [giver]
                    continue
                while tried[i] < len(near[i]) and not (level[j := near[i][tried[i]]] == level[i] + 1 and room[i][j] > 1e-9):
                    tried[i] += 1
                if tried[i] < len(near[i]):
                    path.append(near[i][tried[i]])
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    blocks = text_blocks(page or "")
    keep = min_cut([score(b) for b in blocks], edges(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of whole ``pages``."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_main": op8_html_main}
