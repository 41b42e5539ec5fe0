"""Main text of web pages by a tree-structured graphical model over their elements.

Every block element is a node with two states, content or not. Its own potential is the likelihood ratio of what it looks like (kind
of tag, words of its class and id, share of linked text, length); the potential of an edge is how often a child of its kind is
content below a parent of either state. Sum-product messages go up from the leaves and down from the root, which gives exact marginals in
one pass each way; blocks that are content with a probability above one half make the text.

Potentials are counted on a sample of pages that label themselves: elements under `article` or `main`, but not under an element made for something
else, are content. PRIOR adds the counts of kinds that a sample may lack.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import slices, staged
from scorelake.session import ship_package

#: Pages that potentials are counted on, chosen by the hash of their id.
SAMPLE = 4000

# Element names of HTML by their role, and words that sites use in class and id for what is not the article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p",
         "pre", "search", "section", "select", "summary", "table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "button", "option", "optgroup"}
AWAY_TAGS = {"nav", "aside", "footer", "header", "form", "menu", "dialog", "select", "button", "head", "search", "fieldset", "option", "optgroup"}
MAIN_TAGS = {"article", "main"}
AWAY_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
              "consent", "cookie", "cookies", "copyright", "disqus", "footer", "form", "gdpr", "header", "legal", "links", "login", "masthead", "menu", "modal",
              "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "privacy", "promo", "promoted", "promotion",
              "recommended", "related", "replies", "reply", "respond", "reviews", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
              "sponsored", "subscribe", "toolbar", "topbar", "trending", "warning", "widget", "widgets", "alert", "disclaimer", "discussion", "feedback"}
MAIN_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story", "prose"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "note"}
MAIN_ROLES = {"main", "article"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"},
          "tfoot": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOK = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    kind: str
    pieces: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0


def kind_of(tag: str, attributes: str) -> str:
    """away, main, or the group of the tag."""
    if attributes:
        words: set[str] = set()
        for m in _LOOK.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return "away"
            if name == "role":
                if value.lower() in AWAY_ROLES:
                    return "away"
                if value.lower() in MAIN_ROLES:
                    return "main"
            elif name in ("class", "id"):
                words |= set(_WORD.findall(_SPLIT.sub(" ", value).lower()))
        if tag in AWAY_TAGS or (words & AWAY_WORDS and tag not in ("body", "html")):
            return "away"
        if tag in MAIN_TAGS or words & MAIN_WORDS and tag not in ("body", "html", "p"):
            return "main"
    if tag in AWAY_TAGS:
        return "away"
    if tag in MAIN_TAGS:
        return "main"
    return "root" if tag in ("", "html", "body") else "head" if tag[0] == "h" and len(tag) == 2 else "item" if tag in ("li", "td", "th", "dd", "dt") else (
        "text" if tag in ("p", "pre", "blockquote", "figcaption", "summary") else "group")


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order, parents first, and the text blocks as (element, text)."""
    nodes, stack, blocks = [Node("", -1, "root")], [0], []
    links, at, size = 0, 0, len(page)
    current: list[str] = []

    def end_block() -> None:
        if current:
            text = " ".join(entities.unescape("".join(current)).split())
            if text:
                blocks.append((stack[-1], text))
            current.clear()

    def add(text: str) -> None:
        if text:
            current.append(text)
            if n := len(text) - text.count(" "):
                nodes[stack[-1]].chars += n
                if links:
                    nodes[stack[-1]].linked += n

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[/a-zA-Z!?][^>]*\Z", rest)  # a tag that the page's end cuts off
            add(rest[:cut.start()] if cut else rest)
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(links - 1, 0)
            elif tag in BLOCK:
                k = next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag), 0)
                end_block()
                if k and tag not in ("html", "body"):
                    del stack[k:]
                    links = 0
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
        elif tag == "br":
            current.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCK and tag not in VOID:
            end_block()
            links = 0
            if tag in ("html", "body") and len(stack) > 1 and tag in {nodes[k].tag for k in stack}:
                continue
            if tag == "body":
                del stack[2 if len(stack) > 1 and nodes[stack[1]].tag == "html" else 1:]
            gone = CLOSED_BY.get(tag, set()) | {"p"} | ({tag} if tag[0] == "h" and len(tag) == 2 and tag != "hr" else set())
            scope = SCOPES.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                name = nodes[stack[k]].tag
                if name in gone:
                    del stack[k:]
                    if name not in CLOSED_BY.get(tag, set()):
                        break
                elif name in scope or not scope:
                    break
            nodes.append(Node(tag, stack[-1], kind_of(tag, m[3])))
            stack.append(len(nodes) - 1)
        elif tag == "hr":
            end_block()
    end_block()
    return nodes, blocks


def looks(nodes: list[Node]) -> list[str]:
    """What an element looks like: its kind, and of its whole text the length and the share in links."""
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
    return [f"{n.kind} {'none' if not c else 'short' if c < 80 else 'long'} {'links' if 2 * k > c else 'few' if k else 'plain'}"
            for n, c, k in zip(nodes, chars, linked)]


def edges(nodes: list[Node]) -> list[str]:
    """Kind of each element's edge to its parent: whether the page has a main part, the parent is a root, the child a landmark."""
    main = any(n.kind == "main" for n in nodes)
    return [f"{'marked' if main else 'plain'} {'root' if i and nodes[n.parent].kind == 'root' else 'inner'} "
            f"{n.kind if n.kind in ('main', 'away') else 'other'}" for i, n in enumerate(nodes)]


def own_labels(nodes: list[Node]) -> list[bool] | None:
    """Labels of a page that marks its article itself, or None."""
    if not any(n.tag in MAIN_TAGS for n in nodes):
        return None
    out = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        out[i] = n.kind != "away" and (n.tag in MAIN_TAGS or out[n.parent])
    return out


#: Counts that stand in for kinds a sample may lack: (content, other) by kind of element, and by edge for a parent that is content or not.
PRIOR_LOOK = {"away": (1, 400), "main": (100, 4), "root": (2, 8), "head": (4, 4), "text": (6, 4), "item": (4, 6), "group": (4, 6)}
PRIOR_EDGE = {"main": ((20, 1), (20, 10)), "away": ((1, 400), (1, 400)), "other": ((60, 1), (1, 200))}
PRIOR_PLAIN_ROOT = (60, 1), (40, 40)


@dataclass
class Potentials:
    look: dict[str, tuple[float, float]]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def of_look(self, name: str) -> tuple[float, float]:
        a, b = PRIOR_LOOK[name.split(" ")[0]]
        x, y = self.look.get(name, (0, 0))
        long = 3.0 if " long plain" in name or " long few" in name else 0.3 if name.endswith("links") else 1.0
        a, b = x + a * long, y + b
        return a / (a + b), b / (a + b)

    def of_edge(self, name: str) -> tuple[tuple[float, float], tuple[float, float]]:
        page, parent, child = name.split(" ")
        prior = PRIOR_PLAIN_ROOT if (page, parent, child) == ("plain", "root", "other") else PRIOR_EDGE[child]
        out = []
        for (a, b), (x, y) in zip(prior, self.edge.get(name, ((0, 0), (0, 0)))):
            out.append(((a + x) / (a + b + x + y), (b + y) / (a + b + x + y)))
        return out[0], out[1]


def marginals(parents: list[int], own: list[tuple[float, float]], pair: list[tuple[tuple[float, float], tuple[float, float]]]) -> list[float]:
    """Probability that each node is content. `pair[i]` is the edge's potential, by the parent's state, then the child's;
    a parent comes before its children."""
    n = len(parents)
    below = [list(p) for p in own]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        (cc, co), (oc, oo) = pair[i]
        a, b = below[i]
        m, k = cc * a + co * b, oc * a + oo * b
        up[i] = (m / (m + k), k / (m + k))
        p = below[parents[i]]
        a, b = p[0] * up[i][0], p[1] * up[i][1]
        p[0], p[1] = a / (a + b), b / (a + b)
    a, b = below[0]
    whole = [[a / (a + b), b / (a + b)]] * n
    for i in range(1, n):
        (cc, co), (oc, oo) = pair[i]
        w = whole[parents[i]]
        a, b = w[0] / up[i][0], w[1] / up[i][1]
        a, b = below[i][0] * (a * cc + b * oc), below[i][1] * (a * co + b * oo)
        whole[i] = [a / (a + b), b / (a + b)]
    return [w[0] for w in whole]


def extract(page: str, potentials: Potentials) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    chance = marginals([n.parent for n in nodes], [potentials.of_look(x) for x in looks(nodes)], [potentials.of_edge(x) for x in edges(nodes)])
    return "\n".join(text for i, text in blocks if chance[i] > 0.5)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        out = []
        for page in batch.column("html").to_pylist():
            nodes, _ = parse(page)
            labels = own_labels(nodes)
            if labels is not None:
                for i, (look, edge) in enumerate(zip(looks(nodes), edges(nodes))):
                    out.append(("look", look, False, labels[i]))
                    if i:
                        out.append(("edge", edge, labels[nodes[i].parent], labels[i]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["what", "name", "parent", "label"])


def train(pages: DataFrame, *, sample: int = SAMPLE) -> Potentials:
    """Count potentials on at most `sample` pages, chosen by the hash of their id. Unlabelled pages leave the prior counts."""
    ship_package(pages.sparkSession)
    chosen = pages.select("page_id", "html").dropna().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).select("html")
    counts = (chosen.repartition(16).mapInArrow(_counts, "what string, name string, parent boolean, label boolean")
              .groupBy("what", "name", "parent", "label").count().collect())
    seen = {(r["what"], r["name"], r["parent"], r["label"]): r["count"] for r in counts}
    look = {name: (seen.get(("look", name, False, True), 0), seen.get(("look", name, False, False), 0)) for what, name, *_ in seen if what == "look"}
    edge = {name: tuple((seen.get(("edge", name, p, True), 0), seen.get(("edge", name, p, False), 0)) for p in (True, False))
            for what, name, *_ in seen if what == "edge"}
    return Potentials(look, edge)


def _extract(potentials: Potentials):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(page or "", potentials) for page in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    return run


def extract_text(pages: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """`page_id, url, text, n_chars` for every row of `pages`; null or empty html, and pages without content, have empty text."""
    potentials = train(pages, sample=sample)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        _extract(potentials), "page_id long, url string, text string, n_chars long")
