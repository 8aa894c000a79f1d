"""Main-text extraction by tag-path ratios.

A page's text nodes are grouped by their path of tags from the root. Every path has a text
ratio (text per node) and a punctuation ratio (stops per node); both are smoothed along the
page, fused by their product, and summed up the tree. The fused weights choose the content root:
the main element, if much of its weight lies outside its articles, else all articles that
hold a share of the best one's weight, else the deepest element that holds most of the
page's; on pages without article and main, paths below it must reach a share of the mean
weight. Page furniture is told by tag, role, class and id; names that also occur within
articles (header, legal, related, ...) count there only where the fused weight is low.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var img wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}} | dict.fromkeys(
    ("tr", "td", "th", "thead", "tbody", "tfoot"), {"table"}
)
FURNITURE_TAGS = frozenset("nav footer aside form button select dialog head menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "sidebar aside rail footer foot header masthead topbar cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus respond replies share sharing social related "
    "recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer hidden".split()
)
# fixed values: of these words, those that sections of an article may bear as well
DOUBTFUL_WORDS = frozenset("header head masthead foot footer legal copyright disclaimer related hidden notice notices alert banner rail widget toolbar promotion".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+", re.I)
STOP = re.compile(r"[.,;:!?。，！？]")
SMOOTH = (0.25, 0.5, 0.25)
ROOT_SHARE = 0.6
PATH_SHARE = 0.2
# weight outside its articles from which main is the root; share of the best article that others need
OUTSIDE_SHARE, PART_SHARE = 0.3, 0.2
# share of the mean weight below which a doubtful section is furniture
DOUBT_SHARE = 0.5


@dataclass
class Element:
    tag: str
    label: str
    number: int
    furniture: bool
    doubtful: bool = False


@dataclass
class Node:
    """Text with the elements around it; `block` numbers runs that no block border interrupts."""

    path: tuple[Element, ...]
    text: str
    block: int


def _element(tag: str, attributes: str, number: int, inside: list[Element]) -> Element:
    names, furniture, doubtful = [], tag in FURNITURE_TAGS, False
    within = any(e.tag in ("article", "main") for e in inside)
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if name in ("class", "id"):
            words = NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))
            names += value.split()[:1]
            telling = FURNITURE_WORDS.intersection(w.lower() for w in words) if tag not in ("article", "main", "body", "html") else ()
            only = within and all(w in DOUBTFUL_WORDS for w in telling)
            furniture |= bool(telling) and not only
            doubtful |= bool(telling) and only
        elif name == "role":
            furniture |= value.lower() in FURNITURE_ROLES
        else:
            furniture |= name == "hidden" or value.lower() == "true"
    if tag == "header":  # a heading inside an article belongs to it
        furniture |= not within
    return Element(tag, ".".join([tag, *names[:1]]), number, furniture, doubtful)


def parse(page: str) -> list[Node]:
    """Text nodes in page order; character references decoded, unfinished tags at the end dropped."""
    nodes: list[Node] = []
    stack: list[Element] = []
    at, block, number, end = 0, 0, 0, len(page)

    def text(start: int, stop: int) -> None:
        if stop > start:
            value = html.unescape(page[start:stop])
            nodes.append(Node(tuple(stack), value, block))

    while at < end:
        open_at = page.find("<", at)
        if open_at < 0:
            text(at, end)
            break
        m = TOKEN.match(page, open_at)
        if not m:
            following = page.find("<", open_at + 1)
            stop = following if following > 0 else end
            text(at, stop)
            at = stop
            continue
        text(at, open_at)
        at = m.end()
        closing, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        if at == end and page[-1] != ">":
            break
        tag = tag.lower()
        if closing:
            if tag not in INLINE:
                block += 1
            if any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag not in INLINE:
            block += 1
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag not in INLINE and any(e.tag == "p" for e in stack):
            keep = max(i for i, e in enumerate(stack) if e.tag == "p")
            if all(e.tag in INLINE or e.tag == "p" for e in stack[keep:]):
                del stack[keep:]
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in BARRIERS.get(tag, ()):
                break
            if stack[i].tag in CLOSES.get(tag, ()):
                del stack[i:]
                break
        number += 1
        stack.append(_element(tag, attributes or "", number, stack))
        if (attributes or "").rstrip().endswith("/") and tag in INLINE:
            stack.pop()
    return nodes


def _smooth(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [sum(w * padded[i + k] for k, w in enumerate(SMOOTH)) for i in range(len(values))]


def fused_weights(nodes: list[Node]) -> list[float]:
    """Per node: smoothed text ratio of its path times its smoothed punctuation ratio."""
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    paths = [tuple(e.label for e in n.path) for n in nodes]
    for path, node in zip(paths, nodes):
        s = sums[path]
        s[0] += len(node.text)
        s[1] += len(STOP.findall(node.text))
        s[2] += 1
    length = _smooth([sums[p][0] / sums[p][2] for p in paths])
    stops = _smooth([sums[p][1] / sums[p][2] for p in paths])
    return [x * (0.1 + math.log1p(y)) for x, y in zip(length, stops)]


def _drop_light(nodes: list[Node], weights: list[float]) -> None:
    """Take the weight of doubtful sections whose mean, headings aside, is small beside that of the certain nodes."""
    certain = [w for n, w in zip(nodes, weights) if w and not any(e.doubtful for e in n.path)]
    sections: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(nodes):
        for e in n.path:
            if e.doubtful:
                sections[e.number].append(i)
    limit = DOUBT_SHARE * sum(certain) / len(certain) if certain else 0.0
    for places in sections.values():
        plain = [weights[i] for i in places if not any(e.tag in HEADINGS for e in nodes[i].path)]
        if sum(plain) < limit * len(plain):
            for i in places:
                weights[i] = 0.0


def content_nodes(nodes: list[Node]) -> list[Node]:
    """Nodes of the selected paths."""
    nodes = [n for n in nodes if n.text.strip()]
    if not nodes:
        return []
    fused = fused_weights(nodes)
    weights = [0.0 if any(e.furniture for e in n.path) else w for n, w in zip(nodes, fused)]
    _drop_light(nodes, weights)
    held: dict[int, float] = defaultdict(float)
    depth: dict[int, tuple[int, Element]] = {}
    inside: dict[int, tuple[Element, ...]] = {}
    for node, weight in zip(nodes, weights):
        if weight:
            for d, e in enumerate(node.path):
                held[e.number] += weight
                depth[e.number] = (d, e)
                inside[e.number] = node.path[:d]
    articles = [n for n, (_, e) in depth.items() if e.tag == "article" and not any(x.tag == "article" for x in inside[n])]
    main = max((n for n, (_, e) in depth.items() if e.tag == "main"), key=lambda n: (held[n], -n), default=None)
    least, roots = 0.0, None
    if main is not None:
        own = [n for n in articles if any(x.number == main for x in inside[n])]
        if not articles or held[main] - sum(held[n] for n in own) >= OUTSIDE_SHARE * held[main]:
            roots = {main, *(n for n in articles if n not in own and held[n] > held[main])}
    if roots is None and articles:
        best = max(held[n] for n in articles)
        roots = {n for n in articles if held[n] >= PART_SHARE * best}
    if roots is None:
        total = sum(weights)
        inner = [n for n, (_, e) in depth.items() if held[n] >= ROOT_SHARE * total and e.tag not in INLINE]
        root = max(inner, key=lambda n: (depth[n][0], held[n], -n), default=None)
        if root is not None and depth[root][1].tag != "p":
            roots = {root}
        used = [w for w in weights if w]
        least = PATH_SHARE * sum(used) / len(used) if used else 0.0
    by_path: dict[tuple[str, ...], list[float]] = defaultdict(list)
    for node, weight in zip(nodes, weights):
        by_path[tuple(e.label for e in node.path if e.tag not in INLINE)].append(weight)
    passed = {p for p, w in by_path.items() if max(w) > 0 and max(w) >= least}
    return [
        n for n, w in zip(nodes, weights)
        if w and (roots is None or any(e.number in roots for e in n.path)) and tuple(e.label for e in n.path if e.tag not in INLINE) in passed
    ]


def main_text(page: str | None) -> str:
    """Blocks of the content in page order, one per line, white space within a block made single."""
    nodes = parse(page or "")
    chosen = {id(n) for n in content_nodes(nodes)}
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if id(n) in chosen or (n.block in blocks and not n.text.strip()):
            blocks.setdefault(n.block, []).append(n.text)
    return "\n".join(t for t in (" ".join("".join(parts).split()) for parts in blocks.values()) if t)


def extracted(pages: DataFrame) -> DataFrame:
    """`pages` without html, with text (empty if none) and n_chars.

    A null html gives an empty text. Columns text and n_chars are replaced, others stay; each
    row is treated by itself.
    """
    pages = pages.drop("text", "n_chars")
    names = [n for n in pages.columns if n != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [main_text(page) for page in some.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"]
                )

    schema = T.StructType([*(pages.schema[n] for n in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*names, "html").mapInArrow(run, schema)
