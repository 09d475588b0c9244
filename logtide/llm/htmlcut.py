"""Main text of web pages by minimum-cut labelling.

A page becomes its blocks: runs of text between block-level tags. A linear classifier over a block's
tags, names, links and words gives the costs of calling it content or boilerplate, which are the
capacities of its edges to the source and the sink. Blocks that stand side by side, and blocks under
one parent, are joined by edges whose capacity is the cost of telling them apart. The minimum cut
(Dinic's maximum flow) is the labelling of least total cost; the content side is the main text.

What an element's name says counts for all below it, unless the element holds most of the page's text:
such a one is the page's frame, however it is called. Elements that mean navigation, footers or asides
and names of comments say so at any size. Reading a page takes time in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by what they mean for the text.
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
    section summary table tbody td tfoot th thead tr ul caption""".split()
)
HIDDEN = frozenset("script style noscript template head title iframe object embed svg annotation annotation-xml canvas audio video map select option datalist button textarea".split())
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("nav header footer aside form menu dialog".split())
#: Of these, the ones that may be the frame of a page.
FRAMES = frozenset({"form", "header"})
TOWARDS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the left kind ends where one of the right kinds starts.
ENDS = {
    "p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"}), "head": frozenset({"body"}),
}
BAD_NAME = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|foot|header|masthead|comments?|comment-\w+|reply|replies|disqus|respond|"
    r"share|sharing|social|related|recommend\w*|widget\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search\w*|pag(?:er|ination)|tags?|meta|byline|copyright|legal|toolbar|skip)(?:$|[_-])",
    re.I,
)
COMMENT_NAME = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|respond|reply|replies)(?:$|[_-])", re.I)
GOOD_NAME = re.compile(r"(?:^|[_-])(?:article|content|entry|post|story|body|text|main|page|hentry|blog)(?:$|[_-])", re.I)
#: Names that tell of a page's layout or an article's subject, not of the element's role.
LAYOUT_NAME = re.compile(r"^(?:has|no|with|without|is|not|hide|show|layout|tag|category|cat|type|format|status|theme|skin|single|page|col|row|lang)[_-]", re.I)
BOILER_TEXT = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|(?:use|uses|using|accept|our|of) cookies|cookie (?:policy|settings|notice|consent|preferences)|privacy policy|terms of (?:use|service)|subscribe|sign ?up|log ?in|advertisement|sponsored|share this|read more|click here|newsletter", re.I)

# Weights of the classifier, in nats towards content, and of the smoothness edges.
WEIGHTS = {"bias": 0.4, "away": -5.0, "towards": 3.5, "bad_name": -6.0, "good_name": 1.0, "link": -3.0, "heading": 0.8, "paragraph": 1.2, "list": -0.6, "words": 0.5, "stop": 0.4, "boiler": -3.0}
BESIDE, SIBLINGS = 0.9, 1.1
#: Part of a page's text, and characters, that make an element its frame.
MOST, LONG = 0.5, 200

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    name: str
    parent: int
    away: bool = False
    towards: bool = False
    bad: bool = False
    good: bool = False
    hidden: bool = False
    comments: bool = False
    fixed: bool = False  # says at any size that it is no content


@dataclass
class Block:
    parent: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def blocks_of(page: str) -> tuple[list[Node], list[Block]]:
    """The elements of a page and its blocks of visible text in order."""
    nodes, stack, out = [Node("", -1)], [0], []
    opened: Counter = Counter()  # open elements by name
    inner = [0]  # where in the stack block elements are
    open_block: Block | None = None
    link, at = 0, 0

    def put(raw: str) -> None:
        nonlocal open_block
        if not raw or nodes[stack[-1]].hidden:
            return
        text = entities.unescape(raw)
        if open_block is None:
            if not text.strip():
                return
            open_block = Block(stack[inner[-1]])
            out.append(open_block)
        open_block.parts.append(text)
        if link:
            open_block.linked += len(text.strip())

    def close() -> None:
        nonlocal open_block
        open_block = None

    def pop() -> None:
        nonlocal link
        name = nodes[stack.pop()].name
        opened[name] -= 1
        link -= name == "a"
        if inner[-1] == len(stack):
            inner.pop()

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        m = TAG.match(page, lt)
        if not m:  # a bare "<"
            put(page[at : lt + 1])
            at = lt + 1
            continue
        put(page[at:lt])
        at = m.end()
        if not m[1]:
            if page.startswith("<![CDATA[", lt):
                put(page[lt + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = m[1].lower()
        if page[lt + 1] == "/":
            if name in BLOCK:
                close()
            if opened[name]:
                while nodes[stack[-1]].name != name:
                    pop()
                pop()
            continue
        if name == "br":
            put(" ")
            continue
        if name in BLOCK:
            close()
            while len(stack) > 1 and name in ENDS.get(nodes[stack[-1]].name, ()):
                pop()
            # an open paragraph ends even below inline elements that were left open
            if (k := inner[-1]) and name in ENDS.get(nodes[stack[k]].name, ()):
                while len(stack) > k:
                    pop()
        if name in VOID:
            continue
        up = nodes[stack[-1]]
        attributes = {a.lower(): (b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(m[2])} if m[2] else {}
        label = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop"))
        hidden = up.hidden or name in HIDDEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        names = [x for x in label.split() if not LAYOUT_NAME.match(x)] if name not in ("body", "html") else []
        role = attributes.get("role")
        fixed = (name in AWAY and name not in FRAMES) or role in ("navigation", "banner", "contentinfo", "complementary", "search")
        nodes.append(
            Node(
                name, stack[-1], fixed or name in FRAMES, name in TOWARDS or role in ("main", "article"), any(map(BAD_NAME.search, names)), any(map(GOOD_NAME.search, names)),
                hidden, any(map(COMMENT_NAME.search, names)), fixed,
            )
        )
        if name in BLOCK:
            inner.append(len(stack))
        stack.append(len(nodes) - 1)
        opened[name] += 1
        link += name == "a"
        if m[0].endswith("/>") and name not in BLOCK and name not in RAW:
            pop()
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.start() if end else n
    for b in out:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
        b.parts = []
    out = [b for b in out if b.text]
    _inherit(nodes, out)
    return nodes, out


def _inherit(nodes: list[Node], blocks: list[Block]) -> None:
    """Hands down what elements say to all below them, but for the frames of the page."""
    own = [0] * len(nodes)
    whole = [False] * len(nodes)  # has a page's or an article's own heading below
    for b in blocks:
        own[b.parent] += max(0, len(b.text) - b.linked)
    for i in range(len(nodes) - 1, 0, -1):
        whole[i] |= nodes[i].name in ("h1", "main")
        own[nodes[i].parent] += own[i]
        whole[nodes[i].parent] |= whole[i]
    for i, node in enumerate(nodes[1:], 1):
        up = nodes[node.parent]
        frame = own[i] >= max(LONG, MOST * own[0]) and not node.fixed and (whole[i] or not node.comments)
        header = node.name == "header" and not node.fixed and up.towards  # an article's own
        node.away = up.away or (node.away and not frame and not header)
        node.bad = up.bad or (node.bad and not frame)
        node.towards |= up.towards
        node.good |= up.good


def content_cost(nodes: list[Node], block: Block) -> float:
    """The classifier's log odds that a block is content."""
    node, w = nodes[block.parent], WEIGHTS
    words = block.text.count(" ") + 1
    score = w["bias"] + w["away"] * node.away + w["towards"] * (node.towards and not node.away) + w["bad_name"] * node.bad + w["good_name"] * (node.good and not node.bad)
    score += w["link"] * min(1.0, block.linked / max(1, len(block.text)))
    score += w["heading"] * (node.name in HEADINGS) + w["paragraph"] * (node.name in ("p", "pre", "blockquote")) + w["list"] * (node.name == "li")
    score += w["words"] * (min(words, 60) / 20 - 0.5) + w["stop"] * (block.text[-1] in ".!?…。！？:\"'”)")
    return score + w["boiler"] * bool(words < 40 and BOILER_TEXT.search(block.text))


class Flow:
    """Maximum flow by Dinic's algorithm on arrays."""

    def __init__(self, n: int) -> None:
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(there)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.head)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in self.head[v]:
                if self.cap[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[bool]:
        """Whether each node is on the source's side of the smallest minimum cut."""
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.head)
            path: list[int] = []
            v = s
            while True:
                if v == t:
                    push = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    cut = next(i for i, e in enumerate(path) if self.cap[e] <= 1e-9)
                    path = path[:cut]
                    v = self.to[path[-1]] if path else s
                    continue
                while at[v] < len(self.head[v]):
                    e = self.head[v][at[v]]
                    if self.cap[e] > 1e-9 and level[self.to[e]] == level[v] + 1:
                        path.append(e)
                        v = self.to[e]
                        break
                    at[v] += 1
                else:
                    if v == s:
                        break
                    level[v] = -1
                    e = path.pop()
                    v = self.to[e ^ 1]
        return [x >= 0 for x in level]


def graph(nodes: list[Node], blocks: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The log odds of each block, and the smoothness edges (block, block, cost of telling them apart)."""
    costs, edges = [content_cost(nodes, b) for b in blocks], []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        node = nodes[b.parent]
        if i and (node.away, node.bad) == (nodes[blocks[i - 1].parent].away, nodes[blocks[i - 1].parent].bad):
            edges.append((i - 1, i, BESIDE))
        up = node.parent if node.name not in ("div", "body", "section", "article", "td") else b.parent
        if up in last:
            edges.append((last[up], i, SIBLINGS))
        last[up] = i
    return costs, edges


def labels(nodes: list[Node], blocks: list[Block]) -> list[bool]:
    """Which blocks are content: the minimum cut of costs and smoothness."""
    n, flow = len(blocks), Flow(len(blocks) + 2)
    costs, edges = graph(nodes, blocks)
    for i, cost in enumerate(costs):
        flow.edge(n, i, max(cost, 0.0)) if cost >= 0 else flow.edge(i, n + 1, -cost)
    for a, b, apart in edges:
        flow.edge(a, b, apart, apart)
    return flow.run(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    """The main text of a page, a block a line; empty for a null or empty page."""
    if not page:
        return ""
    nodes, blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, labels(nodes, blocks)) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(v.as_py()) for v in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (a line a block), n_chars (code points).

    A null or empty html gives an empty text, as does a page without content. Ids and urls may be null
    or repeat; each row gets its own result. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
