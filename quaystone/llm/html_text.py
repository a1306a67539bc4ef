"""HTML extraction by minimum-cut labelling of a page's blocks.

A page is read into blocks (the text between the borders of block-level elements) and the elements around them. A linear
classifier over a block's own text (words, share of linked text, closing mark, heading, separating signs) gives its cost. An
element's kind and names are one more cost for each block below it, no larger than a long text's score, and so is how
much of the page's text its section holds. Costs become capacities between a node and the terminal "content" or
"boilerplate". Smoothness edges join every node to the element around it: strongly where a text-level element (a paragraph, heading,
list or table) stands in its section or inside an element of known kind, weakly where sections meet; and
neighbours in page order, heavier the closer they are in the document tree. A maximum flow separates the two sides, and the
blocks on the content side are the text: a short line of an article stays with its paragraphs, a sentence of an advert doesn't.

Null and empty pages give the empty text; pages of any length are read whole; repeated rows are
treated alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import map_batches, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|template|iframe|textarea|title)\b(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.I | re.S,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
# Kinds of elements and names that pages give to their parts.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " svg g text tspan textpath path rect circle ellipse line polyline polygon defs use image symbol stop lineargradient radialgradient clippath marker pattern mask desc"
    " object math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mfenced semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILER_TAGS = frozenset("nav footer aside form button menu dialog head fieldset select".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form gdpr header login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption".split())
SIGNS = re.compile("[©®·•→]")

#: Cost of a block: bias, a word (up to 60), linked share, closing mark, heading, separating signs.
BIAS, WORD, LINKED, MARK, HEADING, SIGN = -0.9, 0.04, -3.0, 0.4, 0.6, -1.5
#: Cost of an element for each block below it: its kind, its names; both together stay within a block's own range.
IN_CONTENT, IN_BOILER, BOILER_NAME, CONTENT_NAME = 0.3, -2.6, -2.6, 0.2
#: Cost of a section for each of its blocks: its words as a share of the longest section's, less what is even.
SHARE, EVEN = 0.6, 0.8
#: Cost of an element of content as a whole, which counts where it has few blocks.
WHOLE = 1.5
#: Edge to the element around, for each block below the inner node: inside an element of known kind, of text-level elements, between sections.
INSIDE, TIED, LOOSE = 2.5, 1.2, 0.1
#: Edge between text-level neighbours of one parent, and of others, divided by their tree distance.
SAME, OTHER = 0.6, 0.1
_EPS = 1e-12


class Block:
    __slots__ = ("text", "words", "linked", "kind", "place", "score")

    def __init__(self, text: str, linked: int, kind: str, place: tuple[int, ...]):
        self.text = text
        self.words = text.count(" ") + 1
        self.linked = min(1.0, linked / len(text))
        self.kind, self.place = kind, place
        self.score = BIAS + WORD * min(self.words, 60) + LINKED * self.linked + MARK * (text[-1] in ".!?:;\"'”»…)") + HEADING * (kind in HEADINGS) + SIGN * (SIGNS.search(text) is not None)


def weight(tag: str, attributes: str, around: int) -> float:
    """What an element says about the blocks below it; around: 1 inside content, -1 inside boilerplate, else 0."""
    w = 0.0
    if tag in BOILER_TAGS or tag == "header" and around <= 0:
        w = IN_BOILER
    elif tag in CONTENT_TAGS and around == 0:
        w += IN_CONTENT
    if attributes and tag not in ("html", "body"):
        parts = {p for m in NAMES.finditer(attributes) for p in PART.findall((m[1] or m[2] or m[3] or "").lower())}
        if parts & BOILER_NAMES and not (tag in CONTENT_TAGS and not parts & {"comment", "comments", "related", "reply"}):
            w = BOILER_NAME
        elif parts & CONTENT_NAMES and around >= 0:
            w += CONTENT_NAME
    return w


class Page:
    """Blocks in page order, and the elements around them: their costs, parents and kinds by number (0: the page)."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.costs: dict[int, float] = {}
        self.parent: dict[int, int] = {}
        self.tag: dict[int, str] = {0: ""}


def read(page: str) -> Page:
    """The page's blocks and elements; scripts and styles have none."""
    out = Page()
    stack: list[list] = [["", 0, 0]]  # tag, number, what it stands in
    place: list[int] = [0]
    text: list[str] = []
    linked, links, number, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = SPACES.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                top = next((x for x in reversed(stack) if x[0] not in INLINE), stack[0])
                out.blocks.append(Block(whole, linked, top[0], tuple(place)))
            text.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] if m[3] else m[5]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag not in INLINE:
                flush()
            if depth:
                for x in stack[depth:]:
                    links -= x[0] == "a"
                del stack[depth:]
                del place[1 + sum(x[0] not in INLINE for x in stack[1:]) :]
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag != "p" or stack[-1][0] != "p":
                closes = CLOSED_BY.get(tag, ())
            else:
                closes = ("p",)
            # an open paragraph ends at a block; formatting that was left open inside it ends with it
            k = len(stack) - 1
            while k and stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] == "p" or stack[k][0] in closes:
                for x in stack[k:]:
                    links -= x[0] == "a"
                del stack[k:]
                del place[1 + sum(x[0] not in INLINE for x in stack[1:]) :]
        attributes = m[4] or m[7] or ""
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        number += 1
        top = stack[-1]
        if tag in INLINE:
            stack.append([tag, top[1], top[2]])
            links += tag == "a"
        else:
            w = weight(tag, attributes, top[2])
            out.costs[number], out.parent[number], out.tag[number] = w, place[-1], tag
            stack.append([tag, number, -1 if w < 0 else 1 if w > 0 else top[2]])
            place.append(number)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def apart(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps between two places in the document tree."""
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return len(a) + len(b) - 2 * k


def sections(page: Page) -> list[tuple[int, float]]:
    """For each block its section (the nearest element around that isn't text-level) and that section's share cost; what stands in boilerplate has no share."""
    own = [next((x for x in reversed(b.place) if page.tag[x] not in TEXT_LEVEL), 0) for b in page.blocks]
    words: dict[int, float] = {}
    for x, b in zip(own, page.blocks, strict=True):
        inside = all(page.costs[y] >= 0 for y in b.place[1:])
        words[x] = words.get(x, 0.0) + inside * b.words * (1.0 - b.linked)
    most = max(words.values(), default=0.0) or 1.0
    return [(x, SHARE * (words[x] / most - EVEN)) for x in own]


def graph_of(page: Page) -> tuple[list[float], list[dict[int, float]]]:
    """Costs of all nodes (blocks, then elements that hold some) and smoothness capacities, both ways."""
    blocks = page.blocks
    below: dict[int, int] = {}
    for b in blocks:
        for x in b.place[1:]:
            below[x] = below.get(x, 0) + 1
    node = {x: len(blocks) + k for k, x in enumerate(sorted(below))}
    score = [b.score for b in blocks] + [page.costs[x] * below[x] + WHOLE * (page.costs[x] > 0) for x in sorted(below)]
    for i, (x, cost) in enumerate(sections(page)):
        score[node.get(x, i)] += cost
    near: list[dict[int, float]] = [{} for _ in score]

    def join(i: int, j: int, c: float) -> None:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c

    known: dict[int, bool] = {0: False}
    for x in sorted(below):  # an element's number is larger than its parent's
        up = page.parent[x]
        known[x] = known[up] or page.costs[x] != 0
        if up:
            edge = LOOSE if page.costs[x] < 0 else INSIDE if known[up] else TIED if page.tag[x] in TEXT_LEVEL else LOOSE
            join(node[x], node[up], below[x] * edge)
    for i, b in enumerate(blocks):
        x = b.place[-1]
        if x:
            join(i, node[x], INSIDE)
        if i:
            before = blocks[i - 1]
            siblings = before.place[:-1] == b.place[:-1] and before.kind in TEXT_LEVEL and b.kind in TEXT_LEVEL
            join(i - 1, i, (SAME if siblings else OTHER) / max(1, apart(before.place, b.place) - 1))
    return score, near


def content_side(score: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Minimum cut by blocking flows over shortest ways: which nodes stay with the content terminal.

    near: residual capacities, changed in place. Every round goes over each edge a few times at most, and the
    ways get longer from round to round.
    """
    n = len(score)
    supply = [max(s, 0.0) for s in score]
    demand = [max(-s, 0.0) for s in score]
    others = [list(x) for x in near]
    while True:
        level = [0 if s > _EPS else -1 for s in supply]
        queue = deque(x for x in range(n) if level[x] == 0)
        found = False
        while queue:
            x = queue.popleft()
            found = found or demand[x] > _EPS
            for y in others[x]:
                if level[y] < 0 and near[x][y] > _EPS:
                    level[y] = level[x] + 1
                    queue.append(y)
        if not found:
            return [k >= 0 for k in level]
        next_ = [0] * n
        for s in range(n):
            while supply[s] > _EPS:
                way = [s]
                while way and demand[way[-1]] <= _EPS:
                    x = way[-1]
                    while next_[x] < len(others[x]):
                        y = others[x][next_[x]]
                        if level[y] == level[x] + 1 and near[x][y] > _EPS:
                            way.append(y)
                            break
                        next_[x] += 1
                    else:
                        way.pop()
                        if way:
                            next_[way[-1]] += 1
                if not way:
                    break
                goal, steps = way[-1], list(zip(way, way[1:], strict=False))
                flow = min(supply[s], demand[goal], *(near[a][b] for a, b in steps))
                supply[s] -= flow
                demand[goal] -= flow
                for a, b in steps:
                    near[a][b] -= flow
                    near[b][a] += flow


def labels(page: Page) -> list[bool]:
    """For each block whether it is content."""
    return content_side(*graph_of(page))[: len(page.blocks)]


def main_text(html_: str | None) -> str:
    page = read(html_ or "")
    return "\n\n".join(b.text for b, k in zip(page.blocks, labels(page), strict=True) if k)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; one map over the scan."""
    return map_batches(pages.select("page_id", "url", "html"), _run, "page_id bigint, url string, text string, n_chars bigint")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
