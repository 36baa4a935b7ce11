"""HTML extraction by minimum-cut labelling.

A page's text is cut into blocks at block-level tags. A classifier gives each block the odds of being content; they become the
capacities of edges to the two terminals. Neighbours in page order, and blocks under one parent, are tied by smoothness edges, stronger the more of
their path they share. A maximum flow finds the labelling of least cost: blocks still reached from the source are content.

The classifier is naive Bayes over hashed features of a block: of its text (tag, length, share of link text, punctuation, place in the page), and of its markup (the
innermost element around it whose tag, role, class or id names a part of a page; its own and its parent's class names; whether it lies outside of an article on a page that has one). All weights are
learnt from the pages themselves: pages with an article or main element label their blocks, content inside, boilerplate outside or in a part of another name inside. Names
of parts start with PRIOR observations, so that one that the pages lack isn't without weight. What text and what markup say is bounded, in nats, on the same scale as
the ties; no name decides by itself, and blocks around can overrule it. A name in a compound, on a text element such as p, or around nearly all of a page's text is no part's name.

Before the flow, blocks whose odds outweigh all their ties are labelled, and their ties become their neighbours' odds; this changes no minimum, and leaves small groups of blocks to the flow, so that
pages of very many blocks take time in proportion.

Pages are read twice, once for the counts, of a fixed size, and once for the labels; no page needs another one, so nothing is shuffled but counts.

Defined cases: a null or empty page gives an empty text; markup that isn't closed, or closed twice, is read as browsers do for the common cases; scripts,
styles, comments, head and form controls never give blocks; a table without labelled blocks leaves the names' prior weights alone; repeated rows give a row each;
null ids and urls are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import need, small_batches, spread
from orrery.llm.packed_sums import total

#: Tags, by what they mean for blocks. Fixed values.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT_TAGS = frozenset("head script style noscript template iframe select button textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that starts closes an open one of the second set, unless one of the third lies between.
CLOSED_BY = {
    "p": (frozenset(["p"]), frozenset("td th div section article aside body li blockquote button".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Markup that names a part of a page: tags and roles, and words of class names and ids. Fixed values.
AWAY_TAGS = frozenset("nav footer aside form menu dialog header".split())
HERE_TAGS = frozenset("article main".split())
AWAY_WORDS = frozenset(
    "ad ads adbox advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr "
    "hidden legal login masthead menu modal nav navbar navigation newsletter notice pagination pager popup popular promo promoted recommended related replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tags toc toolbar trending widget".split()
)
HERE_WORDS = frozenset("article articlebody content entry hentry main post postcontent story text".split())
#: Elements that hold text themselves; a class name on one, or on the page's root, names no part. Fixed values.
TEXT_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 td th pre blockquote figcaption dd dt".split())
NAMELESS_TAGS = TEXT_TAGS | {"html", "body"}
BUCKETS = 1 << 12
#: Observations that a name of a part starts with; nats that text and markup may add at most, and the ties. Share of a page's text from which a name around it says nothing.
PRIOR, TEXT_MOST, MARKUP_MOST = 20, 2.5, 5.0
TIE_NEXT, TIE_PARENT = 0.8, 0.9
ALL = 0.9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
#: An attribute: its whole name, and its value if it has one. Read one after the other, so that nothing inside a name or a value counts as an attribute.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")


class Node:
    """An open element: its tag, its place among all elements, its parent, the innermost block element, the innermost named part with that part's own element, and its class names."""

    __slots__ = ("tag", "number", "parent", "depth", "block", "silent", "part", "owner", "within", "names", "chars")

    def __init__(self, tag: str, number: int, parent: Node | None, names: tuple[str, ...], part: str, silent: bool) -> None:
        self.tag, self.number, self.parent, self.names, self.silent = tag, number, parent, names, silent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK_TAGS else parent.block
        self.within = parent is not None and (parent.within or tag in HERE_TAGS)
        self.part, self.owner = (part, self) if part or parent is None else (parent.part, parent.owner)
        self.chars = 0

    def named(self, useless: set[int]) -> str:
        """The innermost part around it whose name says something."""
        n = self.owner
        while n.part and n.number in useless and n.parent is not None:
            n = n.parent.owner
        return n.part


@dataclass
class Block:
    text: str
    linked: int
    node: Node
    shared: int  # depth of the innermost element that holds this block and the one before


def attributes_of(attributes: str) -> tuple[tuple[str, ...], str]:
    """The class names, ids and roles of an element, and the part that they name: "away", "here" or ""."""
    names: list[str] = []
    part = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            names.append("hidden")
        elif name in ("class", "id", "role"):
            names += value.split()
    for name in names:
        # A compound names a part if all of its words do; the last one tells which.
        words = [w.lower() for x in re.split(r"[_-]+", name) for w in ([x] if x.lower() in AWAY_WORDS or x.lower() in HERE_WORDS else WORDS.findall(x))]
        if words and all(w in AWAY_WORDS or w in HERE_WORDS for w in words):
            part = "away" if words[-1] in AWAY_WORDS else part or "here"
    return tuple(dict.fromkeys(n.lower() for n in names)), part


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    root = Node("", 0, None, (), "", False)
    node, count, at, out = root, 0, 0, []
    parts: list[str] = []
    linked = links = 0
    owner, low = root, 0
    open_: dict[str, int] = {}

    def add(text: str) -> None:
        nonlocal linked, owner
        if text and not node.silent:
            if not parts or not owner.number:
                owner = node.block
            plain = unescape(text)
            parts.append(plain)
            if links:
                linked += len("".join(plain.split()))

    def flush() -> None:
        nonlocal parts, linked, low
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, owner, min(low, owner.depth)))
            low = owner.depth
        parts, linked = [], 0

    def close(until: Node) -> None:
        """Leave all open elements up to this one."""
        nonlocal node, links, low
        while True:
            links -= node.tag == "a"
            open_[node.tag] -= 1
            done, node = node, node.parent
            if done is until:
                break
        low = min(low, node.depth)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if tag in BLOCK_TAGS:
            flush()
        if page[m.start() + 1] == "/":
            if open_.get(tag):
                n = node
                while n.parent is not None and n.tag != tag and not (n.tag in BLOCK_TAGS and tag not in BLOCK_TAGS):
                    n = n.parent
                if n.parent is not None and n.tag == tag:
                    close(n)
            continue
        if tag == "br":
            add(" ")
        if tag in VOID_TAGS:
            continue
        if tag in CLOSED_BY and any(open_.get(t) for t in CLOSED_BY[tag][0]):
            closes, stops = CLOSED_BY[tag]
            n = node
            while n.parent is not None and n.tag not in closes and n.tag not in stops:
                n = n.parent
            if n.parent is not None and n.tag in closes:
                close(n)
        count += 1
        names, part = attributes_of(m[2]) if m[2] else ((), "")
        if tag in HERE_TAGS or (tag in AWAY_TAGS and not (tag == "header" and node.within)):
            part = tag
        elif tag in NAMELESS_TAGS:
            part = ""
        if m[2].endswith("/") and tag == "iframe":
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        node = Node(tag, count, node, names, part, node.silent or tag in SILENT_TAGS)
        open_[tag] = open_.get(tag, 0) + 1
        links += tag == "a"
        if tag == "body":  # a head that was never closed ends here
            node.silent = False
    flush()
    return out


def bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


#: Buckets of the names of parts, and what they start with: observations as content and as boilerplate.
PRIORS = {bucket(f"part {n}"): (1, PRIOR) for n in ("away", *AWAY_TAGS)} | {bucket(f"part {n}"): (PRIOR, 1) for n in ("here", *HERE_TAGS)}


def text_features(block: Block, place: float) -> list[int]:
    """Buckets of what a block's text is like."""
    n = len(block.text)
    named = [f"tag {block.node.tag}", f"length {min(9, int(math.log2(n + 1)))}", f"links {round(4 * block.linked / n)}", f"stops {min(3, len(re.findall('[.!?]', block.text)))}", f"ends {block.text[-1] in '.!?:;\u2026'}", f"place {int(4 * place)}"]
    return [bucket(f) for f in named]


def parts_of(blocks: list[Block]) -> list[str]:
    """The named part that each block is in, or "", with " outside" where the page has an article or main element and the block lies outside of it. A name around nearly all text of a page says nothing."""
    whole = sum(len(b.text) for b in blocks)
    around: dict[int, int] = {}
    for b in blocks:
        n = b.node.owner
        while n.part:
            if n.part in ("away", "here"):
                around[n.number] = around.get(n.number, 0) + len(b.text)
            if n.parent is None:
                break
            n = n.parent.owner
    useless = {number for number, chars in around.items() if chars >= ALL * whole}
    has = any(b.node.within for b in blocks)
    named = [b.node.named(useless) for b in blocks]
    return [f"{part} outside" if has and not b.node.within else part for b, part in zip(blocks, named, strict=True)]


def markup_features(block: Block, part: str) -> list[int]:
    """Buckets of what a block's markup says."""
    names = block.node.names + (block.node.parent.names if block.node.parent else ())
    name, _, outside = part.partition(" ")
    return [bucket(f"part {name}"), *([bucket("outside")] if outside else ()), *(bucket(f"name {n}") for n in dict.fromkeys(names))]


def labelled(block: Block, part: str) -> int | None:
    """What a page's own markup says of a block: 1 for content, 0 for boilerplate, None if nothing."""
    name, _, outside = part.partition(" ")
    if outside or name in AWAY_TAGS or name == "away":
        return 0
    return 1 if block.node.within else None


def count_features(sums: np.ndarray, batch: pa.RecordBatch) -> None:
    """Adds to sums the features of labelled blocks: boilerplate first, content after, each with the number of blocks at its end."""
    for page in batch.column("html").to_pylist():
        blocks = blocks_of(page or "")
        for i, (b, part) in enumerate(zip(blocks, parts_of(blocks), strict=True)):
            label = labelled(b, part)
            if label is not None:
                start = (BUCKETS + 1) * label
                np.add.at(sums, np.array(text_features(b, i / len(blocks)) + markup_features(b, part)) + start, 1)
                sums[start + BUCKETS] += 1


def trained(pages: DataFrame) -> np.ndarray:
    """Log odds for content of each feature's bucket."""
    counts = total(pages.select("html"), 2 * (BUCKETS + 1), count_features).reshape(2, -1).astype(float)
    start = np.ones((2, BUCKETS))
    for at, (content, boilerplate) in PRIORS.items():
        start[:, at] = boilerplate, content
    odds = np.log((counts[1, :-1] + start[1]) / (counts[0, :-1] + start[0]))
    base = np.log((counts[1, -1] + 1) / (counts[0, -1] + 1))
    return np.where(counts[:, :-1].sum(0) > 0, odds - base, odds)


class Flow:
    """Maximum flow by shortest augmenting paths in levels, on the edges of one page's graph."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, room in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source], queue = 0, [source]
        for x in queue:
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] > 1e-9 and level[y] < 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Pushes all flow that fits, and tells which nodes the source still reaches: its side of a minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            done, path = [0] * len(self.out), []
            x = source
            while True:
                if x == sink:
                    pushed = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= pushed
                        self.room[e ^ 1] += pushed
                    full = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    x = self.to[path[full] ^ 1]
                    del path[full:]
                elif done[x] < len(self.out[x]):
                    e = self.out[x][done[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                    else:
                        done[x] += 1
                elif path:
                    x = self.to[path.pop() ^ 1]
                    done[x] += 1
                else:
                    break
        return [v >= 0 for v in level]


def ties(blocks: list[Block]) -> Iterator[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, by the share of ancestors they have in common, and each block with the next under the same parent."""
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = b.node.parent.number if b.node.parent else 0
        if i:
            yield i - 1, i, TIE_NEXT * b.shared / max(blocks[i - 1].node.depth, b.node.depth, 1)
        if parent in last:
            yield last[parent], i, TIE_PARENT
        last[parent] = i


def leanings(blocks: list[Block], odds: np.ndarray) -> list[float]:
    """Each block's own odds for content, in nats."""
    n = len(blocks)
    sure = lambda at, most: min(most, max(-most, float(odds[at].sum())))
    return [sure(text_features(b, i / n), TEXT_MOST) + sure(markup_features(b, part), MARKUP_MOST) for i, (b, part) in enumerate(zip(blocks, parts_of(blocks), strict=True))]


def cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: a block labelled against its leaning costs that much, and each edge between unlike labels its weight."""
    n = len(lean)
    lean = list(lean)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # what outweighs all its ties is settled
        i = todo.pop()
        if label[i] is None and abs(lean[i]) > sum(near[i].values()) + 1e-9:
            label[i] = lean[i] > 0
            for j, w in near[i].items():
                lean[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        flow = Flow(len(left) + 2)
        source, sink = len(left), len(left) + 1
        for i, k in place.items():
            flow.edge(source, k, max(lean[i], 0.0))
            flow.edge(k, sink, max(-lean[i], 0.0))
            for j, w in near[i].items():
                if i < j:
                    flow.edge(k, place[j], w, w)
        for i, side in zip(left, flow.source_side(source, sink), strict=False):
            label[i] = side
    return [bool(x) for x in label]


def label(blocks: list[Block], odds: np.ndarray) -> list[bool]:
    """Which blocks are content, by a minimum cut."""
    return cut(leanings(blocks, odds), list(ties(blocks)))


def main_text(page: str | None, odds: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks, odds), strict=True) if keep) if blocks else ""


def extract(pages: DataFrame, odds: np.ndarray | None = None) -> DataFrame:
    """page_id, url and text of each page. odds: a classifier's weights, from trained(); the pages themselves train it if there are none."""
    need(pages, "page_id", "url", "html")
    work = spread(pages.select("page_id", "url", "html"))
    shared = work.sparkSession.sparkContext.broadcast(trained(work) if odds is None else odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [main_text(p, shared.value) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(work.dtypes)
    return work.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def query(pages: DataFrame) -> DataFrame:
    """Result of op8: a row for each page."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
