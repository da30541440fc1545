"""Main text of web pages by a minimum cut over their text blocks.

A page becomes a list of blocks. A classifier gives each block a cost for being called content and one for being called
boilerplate, from the text's features (length, share of links, sentences, markup between its words, place in the page) and,
as a prior, from what tags and names around it say: the capacities to the two terminals. Blocks that follow each other, and
blocks of one parent, are joined by smoothness edges of the same order, the stronger the more of their path they share. The
maximum flow separates content from boilerplate: a short line among paragraphs goes with them, a sentence in a menu with the menu.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import missing

#: The name after "<" or "</"; what ends a tag or quotes a value in it.
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTE_OR_END = re.compile("[>\"']")
#: Elements whose content is no markup and no text of the page, by where they end.
RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "title")}
ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open paragraph or item that a new block ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "option", "label", "fieldset", "legend", "dialog", "head"}
GOOD_TAGS = {"article", "main"}
#: An element is a wrapper if it holds this share of the page's text, or, with a title or the article's own element in it, that one.
WRAPS, WRAPS_TITLE, TITLES = 0.8, 0.4, {"h1", *GOOD_TAGS}
#: Words of class, id and role names.
BAD_WORDS = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|gdpr|popup|modal|overlay|menu|nav\w*|breadcrumbs?|footer|copyright|masthead|topbar|toolbar|side-?bar|rail|widget|comments?|comment-?list|respond|reply|replies|disqus|related|recommend\w*|share|sharing|social|follow|newsletter|subscribe|signup|login|search|tags?|meta|pagination|pager|alert|hidden|sr-only|complementary|contentinfo|navigation)(?=$|[\s_-])", re.IGNORECASE)
GOOD_WORDS = re.compile(r"(?:^|[\s_-])(article|articlebody|story|post|entry|content|main|body|text)(?=$|[\s_-])", re.IGNORECASE)
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(header|heading|hd)(?=$|[\s_-])", re.IGNORECASE)
#: Names that say of a wrapper what is in it or isn't.
HAS = re.compile(r"\b(?:has|with|without|no|hide|show)-[\w-]+", re.IGNORECASE)
#: Capacities are integers of thousandths, so that the cut is the same on each machine.
UNIT = 1000


class Node:
    """An open element. said: the sum of what it and those around it say; border: it sets its text apart from what is around.

    Both are known when the page has been read: what an element's names say against its text counts only if it isn't a wrapper.
    """

    __slots__ = ("border", "depth", "good", "headed", "held", "names", "number", "parent", "said", "tag")

    def __init__(self, number: int, tag: str, names: str, parent: Node | None):
        self.number, self.tag, self.names, self.parent = number, tag, names, parent
        self.depth = parent.depth + 1 if parent else 0
        self.good = tag in GOOD_TAGS or bool(parent and parent.good)
        self.headed, self.held = tag in TITLES, 0
        self.said, self.border = 0.0, False

    def judge(self, total: int) -> None:
        """After those around it: ``total`` is the length of the page's text, ``held`` that of the text in it."""
        wrapper = self.held >= WRAPS * total or self.headed and self.held >= WRAPS_TITLE * total
        judgement = judged(self.tag, self.names, wrapper)
        if self.tag == "header":
            judgement -= 1.5 if self.good else 6
        self.said = (self.parent.said if self.parent else 0.0) + judgement
        self.border = judgement <= -3 or self.tag in GOOD_TAGS or self.tag == "header"


class Block:
    """A run of text between block-level tags; tags: how many inline ones there were in it."""

    __slots__ = ("linked", "node", "tags", "text")

    def __init__(self, text: str, linked: int, tags: int, node: Node | None):
        self.text, self.linked, self.tags, self.node = text, linked, tags, node


def judged(tag: str, names: str, wrapper: bool = False) -> float:
    """What an element says of the text in it: over 0 content, under 0 boilerplate. A wrapper's names speak of the page's layout."""
    said = 0.0
    if tag in ("html", "body"):
        return said  # their names speak of the whole page
    if tag in BAD_TAGS:
        said -= 6
    if tag in GOOD_TAGS:
        said += 3
    if names:
        names = HAS.sub("", names)
        if BAD_WORDS.search(names):
            said -= 0 if wrapper else 5
        elif GOOD_WORDS.search(names):
            said += 1.5
        if HEADER_WORDS.search(names) and tag not in ("h1", "h2", "h3") and not wrapper:
            said -= 3
        if re.search(r"display:\s*none|visibility:\s*hidden|(?:^|\s)hidden-attribute(?=$|\s)", names):
            said -= 9
    return said


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page: ("text", "", text), ("open", tag, attributes) and ("close", tag, "").

    One pass; what is looked for and isn't there is looked for once, so the time is linear however broken the markup is.
    """
    at = done = 0
    last, quotes = page.rfind(">"), True
    unclosed: set[str] = set()
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:  # without a later ">" nothing is a tag
            break
        if page.startswith(("<!--", "<![CDATA["), start):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(mark, start + 4)
            yield "text", "", page[done:start]
            at = done = len(page) if end < 0 else end + len(mark)
            continue
        m = NAME.match(page, start + 1)
        if not m:
            if page[start + 1] in "!?/":
                yield "text", "", page[done:start]
                at = done = page.find(">", start) + 1
            else:
                at = start + 1
            continue
        end = m.end()
        while quotes:
            found = QUOTE_OR_END.search(page, end)
            if not found:
                quotes = False  # from here on quotes mean nothing: some value isn't closed
                break
            if found[0] == ">":
                end = found.start()
                break
            close = page.find(found[0], found.end())
            if close < 0:
                quotes = False
                break
            end = close + 1
        if not quotes:
            end = page.find(">", m.end())
        tag = m[2].lower()
        yield "text", "", page[done:start]
        at = done = end + 1
        if m[1]:
            yield "close", tag, ""
        elif tag in RAW and not (tag == "svg" and page[end - 1] == "/"):
            over = None if tag in unclosed else RAW[tag].search(page, at)
            if over:
                at = done = over.end()
            elif tag in ("script", "style"):
                at = done = len(page)
            else:
                unclosed.add(tag)  # without an end it holds nothing: what follows is the page's
            yield "raw", tag, ""
        else:
            yield "open", tag, page[m.end() : end]
    # an unclosed comment takes the rest of the page, an unclosed tag is text
    rest = page[done:]
    cut = min((k for k in (rest.find("<!--"), rest.find("<![CDATA[")) if k >= 0), default=len(rest))
    raw = re.search(r"<(?:script|style|noscript|template|svg|textarea|iframe|title)\b[^>]*$", rest[:cut], re.IGNORECASE) if "<" in rest[:cut] else None
    yield "text", "", rest[: raw.start() if raw else cut]


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order. Scripts, styles, titles, comments and markup give none."""
    found: list[Block] = []
    stack: list[Node] = []
    nodes: list[Node] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    linked = number = links = tags = 0

    def flush() -> None:
        nonlocal linked, tags
        if text:
            words = " ".join("".join(text).split())
            if words:
                found.append(Block(words, linked, tags, stack[-1] if stack else None))
            text.clear()
        linked = tags = 0

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if rest:
                rest = entities.unescape(rest) if "&" in rest else rest
                text.append(rest)
                if links:
                    linked += len(rest)
            continue
        if kind == "raw":
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCK:
            flush()
        else:
            tags += 1
        if kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK and opened.get(tag):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
        elif tag == "a":
            links += not rest.rstrip().endswith("/")
        elif tag in BLOCK and tag not in VOID:
            over = ENDS.get(tag, set()) | {"p"}
            while stack and stack[-1].tag in over:
                close(len(stack) - 1)
            links = 0 if tag in ("p", "nav", "article", "footer") else links
            names = ""
            if rest and "=" in rest or "hidden" in rest:
                names = " ".join("hidden-attribute" if a[0].lower() == "hidden" else (a[1] or a[2] or a[3] or "") for a in (x.groups() for x in ATTRIBUTES.finditer(rest)) if a[0].lower() != "aria-hidden")
            number += 1
            opened[tag] = opened.get(tag, 0) + 1
            stack.append(Node(number, tag, names, stack[-1] if stack else None))
            nodes.append(stack[-1])
    flush()
    for block in found:
        if block.node:
            block.node.held += len(block.text)
    for node in reversed(nodes):  # those inside come later
        if node.parent:
            node.parent.held += node.held
            node.parent.headed |= node.headed
    total = max(1, sum(len(b.text) for b in found))
    for node in nodes:
        node.judge(total)
    return found


#: How much the names around a block say at most, for content and against it; how strong an edge is within one parent.
FOR, AGAINST, EDGE = 1.4, 3.0, 1.6
SENTENCE = re.compile(r"[.!?…:;,](?=\s|$)")


def features(block: Block, place: float) -> float:
    """Log-odds by the text alone that a block is content. place: where it stands in the page, 0 to 1."""
    n, words = len(block.text), block.text.count(" ") + 1
    share = min(1.0, block.linked / max(1, n))
    said = 2.0 * min(1.0, words / 25) - 0.9
    said -= 3.0 * share
    said += 0.5 * (block.text[-1] in ".!?…:;\"'»”")
    said += 0.5 * min(1.0, 12 * len(SENTENCE.findall(block.text)) / words) if words > 4 else 0.0
    said -= 0.6 * min(1.0, 3 * block.tags / words)  # markup between few words
    said -= 0.5 * (place < 0.02 or place > 0.98)
    said -= 1.0 * ("©" in block.text[:40] and not (block.node and block.node.good))
    return said


def cost(block: Block, place: float = 0.5) -> float:
    """Log-odds that a block is content: its features, and what the elements around it say, within bounds."""
    said = features(block, place)
    if block.node:
        said += max(-AGAINST, min(FOR, block.node.said))
        said += 1.0 * (block.node.tag in ("h1", "h2", "h3"))
        if block.node.good:  # links in an article are part of its sentences
            said += 2.4 * min(1.0, block.linked / max(1, len(block.text)))
    return said


def smoothness(a: Node | None, b: Node | None) -> float:
    """Strength of the edge between blocks of two nodes: the share of their paths that is common, little across an article's or menu's border."""
    if a is None or b is None:
        return 0.0
    deepest = max(a.depth, b.depth) + 1
    while a is not b:
        if a is None or b is None:
            return 0.0
        if a.depth >= b.depth:
            if a.border:
                return 0.05
            a = a.parent
        else:
            if b.border:
                return 0.05
            b = b.parent
    return EDGE * (a.depth + 1) / deepest if a else 0.0


def problem(blocks: list[Block]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Terminal capacities (over 0 to the source, under 0 to the sink: what both share cancels out) and smoothness edges."""
    n = len(blocks)
    terminal = [round(UNIT * cost(b, (k + 0.5) / n)) for k, b in enumerate(blocks)]
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        pairs = {k - 1} if k else set()
        for node in (b.node.parent, b.node) if b.node else ():  # the block before of the same parent, or the same parent's parent
            if node and node.number in last and node.tag not in ("body", "html"):
                pairs.add(last[node.number])
            if node:
                last[node.number] = k
        for j in pairs:
            if w := round(UNIT * smoothness(blocks[j].node, b.node)):
                edges[j, k] = w
    return terminal, edges


def cut_labels(blocks: list[Block]) -> list[bool]:
    """True for content: the source's side of the minimum cut."""
    terminal, edges = problem(blocks)
    return minimum_cut(terminal, edges)


def minimum_cut(terminal: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """The source's side of a minimum cut.

    A node whose own capacity outweighs all its edges has its terminal's label in every minimum cut. It is set, and its edges
    are added to its neighbours' capacities; so on, until none is left. The flow runs over the rest, part by part.
    """
    n = len(terminal)
    terminal, beside = list(terminal), [{} for _ in range(n)]
    for (a, b), w in edges.items():
        beside[a][b] = beside[a].get(b, 0) + w
        beside[b][a] = beside[b].get(a, 0) + w
    total = [sum(x.values()) for x in beside]
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        k = todo.pop()
        if label[k] is None and abs(terminal[k]) > total[k]:
            label[k] = terminal[k] > 0
            for j, w in beside[k].items():
                if label[j] is None:
                    terminal[j] += w if label[k] else -w
                    total[j] -= w
                    todo.append(j)
    part: list[int] = [-1] * n
    for start in range(n):
        if label[start] is not None or part[start] >= 0:
            continue
        nodes, part[start] = [start], start
        for k in nodes:
            for j in beside[k]:
                if label[j] is None and part[j] < 0:
                    part[j] = start
                    nodes.append(j)
        at = {k: x for x, k in enumerate(nodes)}
        inner = {(at[k], at[j]): w for k in nodes for j, w in beside[k].items() if k < j and j in at}
        for k, side in zip(nodes, _max_flow_side(len(nodes), [terminal[k] for k in nodes], inner), strict=True):
            label[k] = side
    return [bool(x) for x in label]


def _max_flow_side(n: int, terminal: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Dinic's algorithm; node n is the source and n + 1 the sink. Returns which of the n nodes the source still reaches."""
    to, room, at = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(there)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, t in enumerate(terminal):
        if t > 0:
            join(n, k, t, 0)
        elif t < 0:
            join(k, n + 1, -t, 0)
    for (a, b), w in edges.items():
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[k] >= 0 for k in range(n)]
        next_edge = [0] * (n + 2)
        while True:  # one path after the other in the layered graph
            path, a = [], n
            while a != n + 1:
                while next_edge[a] < len(at[a]):
                    e = at[a][next_edge[a]]
                    if room[e] and level[to[e]] == level[a] + 1:
                        break
                    next_edge[a] += 1
                else:
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    next_edge[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if not path:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least


def main_text(page: str | None) -> str:
    """The content blocks in page order, joined by one space; empty if there are none."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, keep in zip(blocks, cut_labels(blocks), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` from its whole html.

    Null html: as empty, so an empty text. Null page_id or url: stay null. Broken markup: an element that isn't closed ends with
    its parent, an unclosed comment or script with the page, an unclosed tag at the end is text. Very long pages take time in
    proportion to their length. Rows that repeat: each. Other columns aren't read. Nothing is shuffled.
    """
    missing(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
