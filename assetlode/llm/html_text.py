"""The main text of web pages by a tree-structured graphical model.

A page is parsed into a tree. Each node has a hidden state, content or not, with a
potential from its tag, the words of its class and id, its place and its text;
each parent and child share a potential. Sum-product messages go up the tree and
down again and leave each node's marginal probability of being content. The
potentials are learnt from labelled pages, which ``training_pages`` writes by
template, the node labels with them.

Defined results: null or empty html, or a page without content, gives an empty
text; repeated rows are extracted each; an empty table gives no rows; columns
other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.llm.arrow import map_rows

# How tags behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
# Controls, and elements whose text no browser shows; all else is for the model to judge.
HIDDEN = frozenset("script style noscript template iframe head title svg canvas audio video select option button input textarea annotation annotation-xml".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main aside nav header footer body html form blockquote figure".split())

# Quantifiers don't give back, so that a tag that doesn't end is read once; PLAIN takes quotes for letters.
_OTHER = r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
TOKEN = re.compile(_OTHER + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
PLAIN = re.compile(_OTHER + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
TAG_START = re.compile(r"</?[a-zA-Z]|<[!?]")
ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
LABEL = re.compile(r"""(?:^|\s)data-content="([01])"(?=\s|/|\Z)""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "items", "depth", "label")

    def __init__(self, tag: str, parent: "Node | None", names: tuple[str, ...] = (), label: int = -1):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.children: list[Node] = []
        self.items: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def name_words(attributes: str, labelled: bool) -> tuple[tuple[str, ...], int]:
    """The words of class, id, role and the like; the label of a ``labelled`` page's node (1, 0, or -1 for none)."""
    words: list[str] = []
    label = -1
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                words.append("hidden")
            elif name != "style":
                words += [w.lower() for w in NAME_PARTS.findall(value)]
        if labelled and (mark := LABEL.search(attributes)):
            label = int(mark[1])
    return tuple(words), label


def parse(page: str, labelled: bool = True) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do in the common cases. Only ``labelled`` pages have labels read.

    A quote that is never closed ends with its tag, and from there on quotes are no
    more than letters; a tag without an end is text. So each part of a page is read
    a bounded number of times, whatever it holds.
    """
    root = Node("#root", None)
    top, at, size = root, 0, len(page)
    last, token = page.rfind(">"), TOKEN
    opened: Counter[str] = Counter()
    while at < size:
        found, begin = None, at
        while (start := TAG_START.search(page, begin)) and (start.start() < last or page.startswith("<!--", start.start())):
            found = token.match(page, start.start())
            if found is None and token is TOKEN:
                found, token = PLAIN.match(page, start.start()), PLAIN
            if found is not None:
                break
            begin = start.end()
        text = page[at : found.start() if found else size]
        if text:
            top.items.append(entities.unescape(text))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if not opened[tag]:
                if tag == "p":
                    top.items.append(Node("p", top))
                continue
            node = top
            while node.parent and node.tag != tag:
                if tag in INLINE and node.tag not in INLINE:
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent:
                top = closed(top, node.parent, opened)
            elif tag == "p":
                top.items.append(Node("p", top))
            continue
        if tag in P_CLOSERS and opened["p"]:
            node = top
            while node.tag in INLINE and node.parent:
                node = node.parent
            if node.tag == "p":
                top = closed(top, node.parent, opened)
        elif tag in CLOSES_OWN and any(opened[t] for t in CLOSES_OWN[tag]):
            node = top
            while node.parent and node.tag not in SCOPES and node.tag not in CLOSES_OWN[tag]:
                node = node.parent
            while node.parent and node.tag in CLOSES_OWN[tag]:
                node = node.parent
                top = closed(top, node, opened)
        names, label = name_words(found[3], labelled)
        node = Node(tag, top, names, label)
        top.children.append(node)
        top.items.append(node)
        if tag in VOID or found[3].endswith("/") and tag not in INLINE and tag not in P_CLOSERS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.items.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        opened[tag] += 1
        top = node
    return root


def closed(top: Node, upto: Node, opened: Counter[str]) -> Node:
    """``upto``, an ancestor of ``top``, when all that is open below it has been closed."""
    while top is not upto:
        opened[top.tag] -= 1
        top = top.parent
    return upto


def nodes_of(root: Node) -> list[Node]:
    """All nodes that can hold content, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed([c for c in node.children if c.tag not in HIDDEN and c.tag not in INLINE]))
    return out


def own_text(node: Node) -> tuple[str, int]:
    """Text of a node and its inline parts, and how much of it is in links."""
    parts: list[str] = []
    linked, stack = 0, [(x, False) for x in reversed(node.items)]
    while stack:
        item, link = stack.pop()
        if isinstance(item, str):
            parts.append(item)
            linked += len(item.strip()) if link else 0
        elif item.tag in INLINE:
            stack.extend((x, link or item.tag == "a") for x in reversed(item.items))
    return " ".join(parts), linked


def features(node: Node) -> list[str]:
    text, linked = own_text(node)
    text = text.strip()
    size = len(text)
    return [
        f"tag:{node.tag}",
        *(f"name:{w}" for w in node.names),
        f"size:{min(size.bit_length(), 9) // 2}",
        f"links:{min(3, 4 * linked // size) if size else 'none'}",
        f"stops:{bool(re.search(r'[.!?]', text))}",
    ]


# The model

#: What a node holds counts for less than what it is: an article may be short, and an advert long.
WEIGHTS = {"size": 0.2, "stops": 0.2, "links": 0.6}


class TreeModel:
    """Log potentials: one weight for each feature, and a two by two table for each tag's edge to its parent."""

    def __init__(self, unary: dict[str, float], edges: dict[str, np.ndarray], bias: float):
        self.unary, self.bias = unary, bias
        self.edges = {k: [[float(v) for v in row] for row in e] for k, e in edges.items()}
        self.edge = self.edges.get("*", [[1.0, 0.1], [0.3, 1.0]])

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each node is content: one pass of messages upward, one downward."""
        place = {id(n): k for k, n in enumerate(nodes)}
        count = len(nodes)
        parent = [place.get(id(n.parent), -1) for n in nodes]
        odds = [max(-30.0, min(30.0, self.bias + sum(self.unary.get(f, 0.0) for f in features(n)))) for n in nodes]
        phi = [(1 / (1 + math.exp(o)), 1 / (1 + math.exp(-o))) for o in odds]
        up = [(1.0, 1.0)] * count
        inside = [list(p) for p in phi]
        for k in range(count - 1, 0, -1):
            a, b = inside[k]
            e = self.edges.get(nodes[k].tag, self.edge)
            m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            s = m0 + m1
            up[k] = (m0 / s, m1 / s)
            p = inside[parent[k]]
            p[0] *= up[k][0]
            p[1] *= up[k][1]
            s = p[0] + p[1]
            p[0] /= s
            p[1] /= s
        belief = [tuple(x) for x in inside]
        for k in range(1, count):
            p = belief[parent[k]]
            c0, c1 = p[0] / max(up[k][0], 1e-300), p[1] / max(up[k][1], 1e-300)
            e = self.edges.get(nodes[k].tag, self.edge)
            d0, d1 = c0 * e[0][0] + c1 * e[1][0], c0 * e[0][1] + c1 * e[1][1]
            b0, b1 = inside[k][0] * d0, inside[k][1] * d1
            s = b0 + b1
            belief[k] = (b0 / s, b1 / s)
        return [b[1] / (b[0] + b[1]) for b in belief]


def train(pages: list[str], strength: float = 0.5) -> TreeModel:
    """Learn potentials by counting in labelled pages (nodes carry data-content, inherited from the parent if absent)."""
    seen: dict[str, list[float]] = {}
    edges: dict[str, np.ndarray] = {}
    totals = [1.0, 1.0]
    for page in pages:
        nodes = nodes_of(parse(page))
        for node in nodes:
            if node.label < 0:
                node.label = node.parent.label if node.parent and node.parent.label >= 0 else 0
            totals[node.label] += 1
            for f in set(features(node)):
                seen.setdefault(f, [strength, strength])[node.label] += 1
            if node.parent:
                for key in (node.tag, "*"):
                    edges.setdefault(key, np.full((2, 2), strength))[node.parent.label, node.label] += 1
    share = math.log(totals[1] / totals[0])
    unary = {f: WEIGHTS.get(f.partition(":")[0], 1.0) * (math.log(b / a) - share) for f, (a, b) in seen.items()}
    joint = {}
    for key, table in edges.items():
        p = table / table.sum()
        joint[key] = p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True))
        joint[key] /= joint[key].max()
    return TreeModel(unary, joint, share)


# Labelled pages

# Words of class and id that the web uses for what is not the article, and for what is.
ASIDE_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav toc",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer bottom copyright colophon legal foot",
    "aside": "sidebar aside related widget trending recommended popular more rail",
    "notice": "cookie consent notice gdpr popup modal overlay alert newsletter subscribe paywall promo",
    "ad": "ad ads advert advertisement sponsored sponsor banner promo adsense",
    "comments": "comments comment reply replies discussion disqus responses respond thread",
    "form": "form search login signup subscribe",
    "share": "share social sharing buttons tags meta byline author pagination pager",
}
CONTENT_NAMES = "article content post entry story main body text"
HTML5 = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "comments": "section", "form": "form"}


def training_pages(count: int = 400, seed: int = 4) -> list[str]:
    """Pages of varied templates whose nodes are labelled with data-content."""
    rng = random.Random(seed)
    # What forms, labels and objects add is drawn apart.
    forms = random.Random(seed + 1)
    letters = "etaoinshrdlu"

    def words(low: int, high: int, rng: random.Random = rng) -> str:
        made = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        return " ".join(made).capitalize() + rng.choice([".", ".", ".", "", "?"])

    def node(tag: str, label: int | None, inner: str, names: str = "") -> str:
        mark = "" if label is None else f' data-content="{label}"'
        kind = rng.choice(["class", "class", "id"])
        return f"<{tag}{f' {kind}={chr(34)}{names}{chr(34)}' if names else ''}{mark}>{inner}</{tag}>"

    def links(tag: str = "ul") -> str:
        items = "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 9)))
        return f"<{tag}>{items}</{tag}>" if rng.random() < 0.8 else "".join(f'<a href="#">{words(1, 3)}</a> ' for _ in range(4))

    def block(kind: str) -> str:
        names = " ".join(rng.sample(ASIDE_NAMES[kind].split(), rng.randint(1, 2)))
        html5 = kind in HTML5 and rng.random() < 0.6
        tag = HTML5.get(kind, "div") if html5 else rng.choice(["div", "div", "section", "aside" if kind == "aside" else "div"])
        if html5 and kind in ("nav", "header", "footer", "aside") and rng.random() < 0.5:
            names = ""
        if kind == "nav":
            inner = links()
        elif kind == "comments":
            inner = node("h3", None, words(1, 2)) + "".join(node(rng.choices(["div", "li", "article"], [6, 4, 1])[0], 0, f"<p>{words(4, 60)}</p>", "comment") for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input type=text><button>{words(1, 1)}</button>"
        elif kind == "footer":
            inner = rng.choice([f"&copy; {words(1, 12)}", f"<p>{words(2, 20)}</p>", links()])
        elif kind == "header":
            inner = rng.choice([f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 6)}</div>", links()]) + rng.choice(["", links()])
        elif kind == "aside":
            inner = node("h3", None, words(1, 3)) + rng.choice([links(), f"<p>{words(3, 40)}</p>", f"<p>{words(3, 30)}</p>" * 2])
        else:
            inner = rng.choice([words(2, 40), f"<p>{words(2, 40)}</p>", f"<p>{words(2, 20)}</p><a href='#'>{words(1, 2)}</a>", f"<span>{words(1, 10)}</span>"])
        return node(tag, 0, inner, names)

    def article() -> str:
        parts = [node(rng.choice(["h1", "h1", "h2"]), 1, words(2, 12))]
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choices(
                [f'<p data-content="1">{words(1, 90)}</p>', node("h2", 1, words(1, 6)), node("blockquote", 1, f"<p>{words(3, 40)}</p>"),
                 node(rng.choice(["ul", "ol"]), 1, "".join(f"<li>{words(1, 20)}</li>" for _ in range(rng.randint(2, 5)))),
                 node("pre", 1, words(3, 20)), node("table", 1, "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3))),
                 node("figure", 1, f"<figcaption>{words(2, 10)}</figcaption>"), node("div", 1, words(3, 60)), block(rng.choice(["ad", "share", "aside", "form", "notice"]))],
                [60, 8, 5, 6, 2, 2, 2, 5, 6])[0])
        if forms.random() < 0.25:
            say = words(1, 40, forms)
            parts.insert(forms.randint(1, len(parts)), forms.choice([
                f'<label data-content="1">{say}</label>', f'<object data-content="1">{say}</object>', f'<object data-content="1"><p>{say}</p></object>',
                f'<div data-content="1"><label>{say}</label></div>', f'<object class="ad" data-content="0"><p>{say}</p></object>',
            ]))
        inner = "".join(parts)
        if rng.random() < 0.3:
            inner = node(rng.choice(["div", "section"]), 1, inner, rng.choice(CONTENT_NAMES.split()))
        if rng.random() < 0.25:
            inner = block("header") + inner
        if rng.random() < 0.25:
            inner += block(rng.choice(["footer", "comments", "share"]))
        if rng.random() < 0.65:
            return node("article", 1, inner, rng.choice(["", "", rng.choice(CONTENT_NAMES.split())]))
        return node(rng.choice(["main", "div", "section"]), 1, inner, " ".join(rng.sample(CONTENT_NAMES.split(), rng.randint(1, 2))))

    out = []
    for _ in range(count):
        before = [block(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
        after = [block(k) for k in ("aside", "comments", "share", "ad", "footer", "notice") if rng.random() < 0.5]
        rng.shuffle(before)
        body = "".join(before) + article() + "".join(after)
        if rng.random() < 0.3:
            body = node("div", 0, body, rng.choice(["wrapper", "page", "container", "site"]))
        if forms.random() < 0.2:
            names = forms.choice(['id="aspnetForm"', 'id="form1"', 'id="mainForm"', 'name="page"', ""])
            body = f'<form {names} method="post" data-content="0"><input type="hidden">{body}{forms.choice(["</form>", ""])}'
        out.append(f"<html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>")
    return out


@functools.lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return train(training_pages())


# Extraction


def blocks(page: str | None, model: TreeModel, threshold: float = 0.5) -> list[str]:
    """The content blocks of a page in its order, white space made single."""
    if not page:
        return []
    root = parse(page, labelled=False)
    nodes = nodes_of(root)
    content = {id(n): p >= threshold for n, p in zip(nodes, model.marginals(nodes))}
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(text)
        parts.clear()

    stack: list[tuple[object, bool]] = [(root, False)]
    while stack:
        item, keep = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if keep:
                parts.append(item)
        elif item.tag == "br":
            parts.append(" ")
        elif item.tag in HIDDEN:
            continue
        elif item.tag in INLINE:
            stack.extend((x, keep) for x in reversed(item.items))
        else:
            flush()
            stack.append((None, False))
            stack.extend((x, content[id(item)]) for x in reversed(item.items)) if id(item) in content else stack.extend((x, keep) for x in reversed(item.items))
    flush()
    return out


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kinds = dict(pages.dtypes)

    def run(part: pa.RecordBatch) -> dict:
        texts = ["\n\n".join(blocks(p, shared.value)) for p in part.column("html").to_pylist()]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_rows(pages.select("page_id", "url", F.col("html")), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
