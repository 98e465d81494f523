"""HTML extraction: a minimum cut separates content blocks from boilerplate."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import body, bound_batches

# Fixed values of HTML: what has no end tag, what holds no page text, what breaks lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe head title textarea select option button object canvas datalist audio video".split())
#: What may stand in head; text and all other start tags end it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Hidden elements that, where their end tag is missing, end at the next block.
HALF_OPEN = frozenset("button select object canvas datalist audio video svg".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these kinds, unless a scope lies between.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
}
P_ENDS = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}

# The classifier: log-odds of content, added up along a block's ancestors and over its own text.
TAG_ODDS = {
    "article": 3.5, "main": 2.5, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0,
    "header": -5.0, "figcaption": -0.5, "h1": 1.0, "h2": 0.5, "h3": 0.5, "p": 0.5, "pre": 0.5, "blockquote": 0.5,
}
#: A title in an article's own header belongs to the article.
ARTICLE_HEADER = -1.0
BAD_NAMES = re.compile(
    r"^(ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebar\w*|aside|rail|footer|foot|masthead"
    r"|topbar|header|cookies?|cookiebar|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe\w*|signup|login|search|share|sharing"
    r"|social|comments?|commentlist|disqus|replies|reply|respond|reader|discussion|related|recommend\w*|trending|popular|pagination|pager|widgets?|copyright|legal"
    r"|disclaimer|tags|toolbar|skip|contentinfo|complementary|hidden)$"
)
GOOD_NAMES = re.compile(r"^(article|articlebody|content|post|entry|story|main|maincontent|body|text|prose)$")
BAD_NAME, GOOD_NAME = -6.0, 2.0
LINKS, LONG, SENTENCE, TERSE = -5.0, 2.5, 0.7, -0.8
PHRASES = re.compile(
    r"^\W{0,3}(©|\(c\)\s|copyright\b)|all rights reserved|\b(privacy policy|terms of (use|service)|use cookies|accept cookies|sign up|log in"
    r"|subscribe (now|to)|share this|leave a (comment|reply)|related (articles|posts|stories)|advertisement|skip to)\b", re.I,
)
PHRASE, LONG_WORDS = -4.0, 30
#: Smoothness: between neighbours by the steps between them in the tree, and between blocks of one parent.
NEAR, SIBLING = 2.0, 0.8
#: Capacities are integers.
UNIT = 1000

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: A tag's attributes if no "<" stands in them, as is usual.
_ATTRIBUTES = re.compile(r"""((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>""")
_SPECIAL = re.compile(r"""[>"']""")
_REMARK = re.compile(r"<[!?]")
_HALF_OPEN = re.compile(rf"<(/?)({'|'.join(sorted(HALF_OPEN))})(?=[\s/>])", re.I)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_OFF = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_END_OF_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)]*$")


def _ended(html: str) -> set[int]:
    """Where the HALF_OPEN start tags that have an end tag begin."""
    ended, begun = set(), {tag: [] for tag in HALF_OPEN}
    for m in _HALF_OPEN.finditer(html):
        own = begun[m[2].lower()]
        if not m[1]:
            if m[2].lower() in ("button", "select"):  # these do not nest
                own.clear()
            own.append(m.start())
        elif own:
            ended.add(own.pop())
    return ended


class TagEnds:
    """Where tags end: at the next ">" outside quotes, or if there is none, at the next one.

    Each quote's way to the end is followed once, and what lies ahead of the
    tags, which come in page order, is looked up once: a page takes linear time.
    """

    def __init__(self, html: str):
        self.html = html
        self.end_of: dict[int, int] = {}
        self.special, self.any_end = -1, -1

    def after(self, at: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin at ``at``; one must follow."""
        html, path = self.html, []
        if self.special < at:
            self.special = self._special(at)
        q = self.special
        while q < len(html) and html[q] != ">" and q not in self.end_of:
            path.append(q)
            closed = html.find(html[q], q + 1)
            q = self._special(closed + 1) if closed >= 0 else len(html)
        end = self.end_of.get(q, q)
        self.end_of.update(dict.fromkeys(path, end))
        if end < len(html):
            return end
        if self.any_end < at:
            self.any_end = html.index(">", at)
        return self.any_end

    def _special(self, at: int) -> int:
        m = _SPECIAL.search(self.html, at)
        return m.start() if m else len(self.html)


@dataclass
class Block:
    text: str
    odds: float
    linked: float
    parent: int
    #: Steps in the tree from the block before.
    steps: int


def _name_odds(attributes: str) -> float:
    odds = 0.0
    for m in _NAMES.finditer(attributes):
        parts = [x for x in re.split(r"[^a-z]+", m[1].lower()) if x]
        if any(map(BAD_NAMES.match, parts)):
            return BAD_NAME
        if any(map(GOOD_NAMES.match, parts)):
            odds = GOOD_NAME
    return odds


def blocks(html: str) -> list[Block]:
    """The page's text blocks in page order; broken and unclosed markup is read leniently."""
    # stack: tag, number, odds down to here, inside a link, hidden, inside an article
    stack: list[tuple] = [("", 0, 0.0, False, False, False)]
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    number, low, depth_of_last, at = 0, 0, 0, 0
    ended: set[int] | None = None
    # places in the stack: of each tag, of all blocks, of half-open elements without an end tag
    places: dict[str, list[int]] = {}
    blocks_at: list[int] = []
    unended: list[int] = []
    ends, last = TagEnds(html), html.rfind(">") + 1

    def flush() -> None:
        nonlocal low, depth_of_last
        if not parts:
            return
        text = " ".join("".join(t for t, _ in parts).split())
        linked = sum(len(t) for t, a in parts if a) / max(1, sum(len(t) for t, _ in parts))
        parts.clear()
        if not text:
            return
        top = stack[blocks_at[-1] if blocks_at else 0]
        depth = len(stack)
        steps = depth_of_last + depth - 2 * min(low, depth)
        found.append(Block(text, top[2], linked, top[1], steps))
        low = depth_of_last = depth

    def close(to: int) -> None:
        nonlocal low
        if blocks_at and blocks_at[-1] >= to:
            flush()
        for x in stack[to:]:
            places[x[0]].pop()
        del stack[to:]
        for listed in (blocks_at, unended):
            while listed and listed[-1] >= to:
                listed.pop()
        low = min(low, to)

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def open_at(tags: str, scopes: tuple) -> int | None:
        i = innermost(tags.split())
        return i if i > innermost(scopes) else None

    def add(text: str) -> None:
        if stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not stack[-1][4]:
            parts.append((unescape(text) if "&" in text else text, stack[-1][3]))

    while True:
        m = _START.search(html, at, last) if at < last else None
        if m is None:
            # no tag ends from here on, but a comment may begin
            m = _REMARK.search(html, at)
            add(html[at : m.start() if m else len(html)])
            break
        add(html[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2]
        if tag is None:
            closing = "-->" if m[0] == "<!--" else ">"
            stop = html.find(closing, at)
            at = len(html) if stop < 0 else stop + len(closing)
            continue
        usual = _ATTRIBUTES.match(html, at)
        stop = usual.end(1) if usual else ends.after(at)
        attributes, at = html[at:stop], stop + 1
        tag = tag.lower()
        if end:
            if i := innermost((tag,)):
                close(i)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in BLOCK and unended and stack[-1][4]:
            close(unended[0])
        if tag in P_ENDS and (i := open_at("p", ("button", "td", "th", "table"))):
            close(i)
        if tag in CLOSES and (i := open_at(*CLOSES[tag])):
            close(i)
        if tag in BLOCK:
            flush()
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ")
            continue
        number += 1
        _, _, odds, link, hidden, article = stack[-1]
        own = TAG_ODDS.get(tag, 0.0)
        if tag == "header" and article:
            own = ARTICLE_HEADER
        if "=" in attributes:
            own = min(own, named) if (named := _name_odds(attributes)) < 0 else own + named
        off = hidden or tag in HIDDEN or bool(attributes and _OFF.search(attributes))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = len(html) if stop is None else stop.end()
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in HALF_OPEN:
            ended = _ended(html) if ended is None else ended
            if m.start() not in ended:
                unended.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks_at.append(len(stack))
        stack.append((tag, number, odds + own, link or tag == "a", off, article or tag in ("article", "main")))
    flush()
    return found


def odds(block: Block) -> float:
    """Log-odds that a block is content."""
    words = block.text.count(" ") + 1
    x = block.odds + LINKS * block.linked + LONG * min(words, LONG_WORDS) / LONG_WORDS
    x += SENTENCE if _END_OF_SENTENCE.search(block.text) else 0.0
    x += TERSE if words < 5 else 0.0
    return x + (PHRASE if words < 2 * LONG_WORDS and PHRASES.search(block.text) else 0.0)


def edges_of(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: page neighbours, and the next block of the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, round(UNIT * NEAR / (1 + b.steps))))
        j = last.get(b.parent)
        if j is not None and j < i - 1:
            out.append((j, i, round(UNIT * SIBLING)))
        last[b.parent] = i
    return [e for e in out if e[2] > 0]


def min_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost, True on the source's side.

    ``terminal`` is the source's capacity less the sink's.  A node whose terminal
    outweighs all its edges is settled first and hands its edges to the terminals
    of its neighbours, which is exact; maximum flow labels the rest, and nodes
    that either label suits stay on the sink's side.
    """
    excess = list(terminal)
    near: list[dict[int, int]] = [{} for _ in terminal]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * len(terminal)
    queue = deque(range(len(terminal)))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(excess[i]) < sum(near[i].values()) or (excess[i] == 0 and near[i]):
            continue
        label[i] = excess[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            excess[j] += w if label[i] else -w
            queue.append(j)
        near[i] = {}
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        for i, side in zip(rest, _max_flow({i: excess[i] for i in rest}, {i: near[i] for i in rest})):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(excess: dict[int, int], near: dict[int, dict[int, int]]) -> list[bool]:
    """Shortest augmenting paths by levels; what the source still reaches is on its side."""
    give = {i: max(0, x) for i, x in excess.items()}
    take = {i: max(0, -x) for i, x in excess.items()}
    left = {i: dict(js) for i, js in near.items()}
    while True:
        level = {i: 0 for i, x in give.items() if x > 0}
        ring = deque(level)
        reached = False
        while ring:
            i = ring.popleft()
            reached |= take[i] > 0
            for j, c in left[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    ring.append(j)
        if not reached:
            return [i in level for i in excess]
        todo = {i: iter(list(left[i])) for i in level}
        for s in [i for i, k in level.items() if k == 0]:
            path = [s]
            while path and give[s] > 0:
                i = path[-1]
                if take[i] > 0:
                    flow = min([give[s], take[i], *(left[a][b] for a, b in zip(path, path[1:]))])
                    give[s] -= flow
                    take[i] -= flow
                    for a, b in zip(path, path[1:]):
                        left[a][b] -= flow
                        left[b][a] += flow
                    keep = next((k for k, (a, b) in enumerate(zip(path, path[1:])) if not left[a][b]), len(path) - 1)
                    del path[keep + 1 :]
                    if take[path[-1]] > 0:
                        continue
                    i = path[-1]
                j = next((j for j in todo[i] if left[i][j] > 0 and level.get(j) == level[i] + 1), None)
                if j is None:
                    path.pop()
                else:
                    path.append(j)


def main_blocks(html: str) -> tuple[list[Block], list[bool]]:
    found = blocks(html)
    return found, min_cut([round(UNIT * odds(b)) for b in found], edges_of(found))


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    found, content = main_blocks(html or "")
    return " ".join(b.text for b, c in zip(found, content) if c)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``main``: struct<text, n_chars, n_blocks, n_content>.

    A page's blocks are nodes; the classifier's log-odds are their terminal
    capacities, page neighbourhood and the shared parent their edges, and the
    minimum cut keeps the blocks on the content side.  Character references are
    decoded, white space in a block becomes one space.

    All of it works on a row alone and on whole pages.  A null or empty page has
    the empty text and no blocks; rows that repeat give equal results.  A column
    named ``main`` is replaced, all others stay.
    """

    bound_batches(pages.sparkSession)
    @F.pandas_udf("text string, n_chars long, n_blocks long, n_content long")
    def extracted(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            rows = []
            for html in batch:
                found, content = main_blocks(html)
                text = " ".join(b.text for b, c in zip(found, content) if c)
                rows.append((text, len(text), len(found), sum(content)))
            yield pd.DataFrame(rows, columns=["text", "n_chars", "n_blocks", "n_content"])

    return pages.withColumn("main", extracted(body(html_col)))
