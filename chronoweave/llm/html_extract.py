"""Main text of web pages: sum-product over the tree of block elements.

A page is parsed to its tree of block elements. Each node is content or boilerplate. Its own features (tag, class and id words,
length, share of linked text) give a unary potential, and each parent and child share a pairwise potential. One upward and one downward
pass of sum-product messages give the exact marginal of every node; the text of nodes whose marginal of content is over one half is
the result. The potentials are trained by gradient ascent on the likelihood of labelled pages, where the same
two passes give the expected counts. The labelled pages are made here, from templates with random words.

Defined results: a null or empty page has the empty text; markup that never closes ends with the page; text outside any element counts as
the body's; script, style, head, form controls, templates, frames and comments in the markup never give text, formulas and other inline content
do; very long pages are read whole, in time that grows with their length only; repeated rows and other columns are carried along, but an input
column named like the output is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAMED = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
NAME = re.compile(r"[a-z]+")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe select button option".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag of the key ends an open element of the value's tags.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}


class Node:
    """A block element: its tag, class and id words, parent and direct text."""

    __slots__ = ("tag", "names", "parent", "children", "chars", "linked", "label", "extra")

    def __init__(self, tag: str, names: list[str], parent: Node | None, label: int | None):
        self.tag, self.names, self.parent, self.label = tag, names, parent, label
        self.children: list[Node] = []
        self.chars = self.linked = 0
        self.extra = ""
        if parent is not None:
            parent.children.append(self)


class _Scanner:
    """Where markup ends, each part of the page looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.hopeless: set[int] = set()  # places of quotes, met outside quotes, from which no end is found
        self.unclosed: set[str] = set()

    def end_of_tag(self, at: int) -> int:
        """The place after the '>' that ends a tag whose name ends at `at`: not one in quotes, unless nothing else ends it."""
        page, seen, here = self.page, [], at
        while m := SPECIAL.search(page, here):
            if m[0] == ">":
                return m.end()
            if m.start() in self.hopeless:
                break
            seen.append(m.start())
            here = page.find(m[0], m.end()) + 1
            if not here:
                break
        self.hopeless.update(seen)
        return page.find(">", at) + 1

    def after(self, tag: str, at: int) -> int | None:
        """The place after the next end tag of `tag`; none if there is none."""
        if tag in self.unclosed:
            return None
        m = re.compile(rf"</{tag}\b", re.I).search(self.page, at)
        if m is None or m.end() > self.last:
            self.unclosed.add(tag)
            return None
        return self.page.find(">", m.end()) + 1


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The block elements, parents before children, and the texts with their element, in page order."""
    root = Node("body", [], None, None)
    nodes, blocks = [root], []
    stack: list[tuple[str, Node]] = []  # open elements, inline ones with the block they are in
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    opened: list[int] = []  # places of open blocks
    at, here, links = 0, root, 0
    held: list[str] = []
    scan, end = _Scanner(page), len(page)

    def flush() -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((here, text))
                here.chars += len(text)

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def push(tag: str, node: Node) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            opened.append(len(stack))
        stack.append((tag, node))

    def pop_to(depth: int) -> None:
        nonlocal here, links
        while len(stack) > depth:
            tag, node = stack.pop()
            places[tag].pop()
            if tag == "a":
                links -= 1
            elif tag in BLOCK:
                opened.pop()
                flush()
                here = node.parent or root

    def say(text: str) -> None:
        held.append(text)
        if links:
            here.linked += len(text)

    while at < end:
        start = page.find("<", at)
        if start < 0 or start > scan.last:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            if at < 3:
                break
            continue
        m = NAMED.match(page, start + 1)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
            else:
                say("<")
                at = start + 1
            continue
        at = scan.end_of_tag(m.end())
        if not at:  # nothing ends it: text
            say(page[start:])
            break
        tag, rest = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            found = innermost((tag,))
            if tag not in ("html", "body") and found >= 0 and (tag in BLOCK or not opened or found > opened[-1]):
                pop_to(found)
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                close = scan.after(tag, at)
                at = close or (end if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag == "head":
            close = re.compile(r"</head\s*>|<body\b", re.I).search(page, at) if "head" not in scan.unclosed else None
            if close is None:
                scan.unclosed.add("head")
            else:
                at = close.start() if close[0][1] != "/" else close.end()
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            if places.get("p"):
                pop_to(places["p"][-1])
            if tag in CLOSES and (found := innermost(CLOSES[tag])) > innermost(SCOPE[tag]):
                pop_to(found)
            flush()
            names, label = [], None
            if "=" in rest:
                for a in ATTRIBUTE.finditer(rest):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key in ("class", "id", "role"):
                        names += NAME.findall(value.lower())
                    elif key == "data-content-label":
                        label = int(value)
            here = Node(tag, names, here, label)
            nodes.append(here)
            push(tag, here)
        else:
            links += tag == "a"
            push(tag, here)
    pop_to(0)
    flush()
    return nodes, blocks


def features(node: Node) -> list[str]:
    """What the unary potential sees of a node."""
    out = ["bias", "t:" + node.tag]
    out += ["c:" + x for x in set(node.names)]
    n = node.chars
    if n:
        out.append("n:" + ("0" if n < 25 else "1" if n < 80 else "2" if n < 250 else "3"))
        share = node.linked / n
        out.append("k:" + ("0" if share < 0.1 else "1" if share < 0.5 else "2"))
    return out


class Model:
    """Weights of the features and the pairwise potentials [parent][child], as logarithms."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    def unary(self, node: Node) -> float:
        weight = self.weight
        return sum([weight.get(f, 0.0) for f in features(node)])

    def marginals(self, nodes: list[Node], scores: list[float]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """For each node the probability of content; and of (parent, child) = 00, 01, 10, 11, for the root zeros."""
        n = len(nodes)
        at = {id(x): i for i, x in enumerate(nodes)}
        parent = [-1 if x.parent is None else at[id(x.parent)] for x in nodes]
        (p00, p01), (p10, p11) = [[math.exp(v) for v in row] for row in self.pair]
        own = [math.exp(max(-30.0, min(30.0, s))) for s in scores]  # of content, against 1
        b0, b1 = [1.0] * n, own[:]  # product of the unary and the messages from below
        u0, u1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            m0, m1 = p00 * b0[i] + p01 * b1[i], p10 * b0[i] + p11 * b1[i]
            total = m0 + m1
            u0[i], u1[i] = m0 / total, m1 / total
            j = parent[i]
            x0, x1 = b0[j] * u0[i], b1[j] * u1[i]
            total = x0 + x1
            b0[j], b1[j] = x0 / total, x1 / total
        probability, pairs = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        f0, f1 = [0.0] * n, [0.0] * n  # belief: all that is known of the node
        for i in range(n):
            if i == 0:
                x0, x1 = b0[0], b1[0]
            else:
                j = parent[i]
                w0, w1 = f0[j] / u0[i] if u0[i] else 0.0, f1[j] / u1[i] if u1[i] else 0.0
                q = (w0 * p00 * b0[i], w0 * p01 * b1[i], w1 * p10 * b0[i], w1 * p11 * b1[i])
                total = sum(q) or 1.0
                pairs[i] = q = (q[0] / total, q[1] / total, q[2] / total, q[3] / total)
                x0, x1 = q[0] + q[2], q[1] + q[3]
            total = x0 + x1
            f0[i], f1[i] = x0 / total, x1 / total
            probability[i] = f1[i]
        return probability, pairs

    def text(self, page: str | None) -> str:
        """The main text: blocks in page order, joined by an empty line."""
        if not page:
            return ""
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        probability, _ = self.marginals(nodes, [self.unary(x) for x in nodes])
        content = {id(x) for x, p in zip(nodes, probability, strict=True) if p > 0.5}
        return "\n\n".join([t for node, t in blocks if id(node) in content])


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    """Pages made from templates; data-content-label marks where content (1) and boilerplate (0) begin."""
    rng = random.Random(seed)
    syllables = "ba de ri no lu ta mi so ke va er an en st ou ly".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
    close = lambda tag: f"</{tag}>" if rng.random() < 0.9 else ""

    def prose(longest: int) -> str:
        text = (say(1, longest) + rng.choice([".", ".", ",", ""])).capitalize()
        kind = rng.random()
        if kind < 0.15:
            return f"<b>{text}<br>"
        if kind < 0.25:
            return f"{text} {link()} {say(1, 12)}"
        return f"<em>{text}</em> {say(1, 5)}" if kind < 0.3 else text

    def items(k: int, inner) -> str:
        return "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(k)) + "</ul>"

    def article() -> str:
        out = [f"<h{rng.choice('1112')}>{say(1, 9)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(0, 9)):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{prose(rng.choice([2, 8, 40, 90]))}{close('p')}")
            elif kind < 0.78:
                out.append(f"<h{rng.choice('234')}>{say(1, 6)}</h2>")
            elif kind < 0.84:
                out.append(items(rng.randint(1, 5), lambda: prose(15)))
            elif kind < 0.88:
                out.append(f"<blockquote><p>{prose(30)}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src='x'><figcaption>{say(2, 12)}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<pre>{say(2, 20)}</pre>")
            elif kind < 0.98:
                out.append(f"<div>{prose(40)}</div>")
            else:
                out.append(f"<section><h2>{say(1, 4)}</h2><p>{prose(40)}</p></section>")
            if rng.random() < 0.15:
                out.append(boilerplate(rng.choice(["ad", "notice", "share", "related", "aside", "form", "newsletter"])))
        return "".join(out)

    def boilerplate(kind: str) -> str:
        off = 'data-content-label="0"'
        several = rng.randint(2, 7)
        plain = lambda: rng.choice([f"<p>{say(2, 25)}</p>", say(2, 25), f"<span>{say(1, 9)}</span> {link()}"])
        if kind == "nav":
            tag, more = rng.choice([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="menu"'), ("div", ' id="navigation"'), ("div", ' class="breadcrumb"'), ("ul", ' class="nav menu"'), ("div", ' class="nav navbar"'), ("menu", "")])
            return f"<{tag}{more} {off}>{items(several, link) if rng.random() < 0.8 else ' | '.join(link() for _ in range(several))}</{tag}>"
        if kind == "header":
            tag, more = rng.choice([("header", ""), ("header", ' class="site-header"'), ("div", ' class="header"'), ("div", ' id="header"'), ("div", ' class="masthead banner"')])
            return f"<{tag}{more} {off}>{rng.choice([f'<h1>{say(1, 3)}</h1>', f'<p>{say(1, 6)}</p>', link(), say(1, 4)])}{boilerplate('nav') if rng.random() < 0.4 else ''}</{tag}>"
        if kind == "footer":
            tag, more = rng.choice([("footer", ""), ("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"'), ("div", ' class="copyright legal"')])
            return f"<{tag}{more} {off}>{rng.choice([f'&copy; {say(1, 3)} &middot; {say(2, 18)}', f'<p>{say(3, 20)}</p>', items(several, link)])}</{tag}>"
        if kind in ("sidebar", "aside", "related"):
            tag, more = rng.choice([("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="related"'), ("section", ' class="related recommended"'), ("div", ' class="widget"')])
            return f"<{tag}{more} {off}><h3>{say(1, 3)}</h3>{rng.choice([items(several, link), plain(), items(several, lambda: say(1, 8))])}</{tag}>"
        if kind in ("ad", "notice", "newsletter", "share"):
            name = rng.choice({"ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"], "notice": ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "banner"], "newsletter": ["newsletter", "subscribe", "signup"], "share": ["share", "social", "tags", "meta", "byline"]}[kind])
            return f'<{(t := rng.choice(["div", "div", "div", "section", "p", "aside"]))} {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "-box", " box", "-1"])}" {off}>{say(1, 25) if t == "p" else plain()}</{t}>'
        if kind == "form":
            return f'<form action="/s" {off}><p>{say(1, 9)}</p><label>{say(1, 3)}</label><input name="q"><button>{word()}</button></form>'
        tag, more = rng.choice([("section", ' class="comments"'), ("div", ' id="comments"'), ("div", ' class="comment-list"'), ("ol", ' class="comments"'), ("section", ' id="reader-comments"')])
        one = lambda: rng.choice([f'<div class="comment"><p>{say(2, 60)}</p></div>', f'<article class="comment"><p>{say(2, 60)}</p></article>', f"<p>{say(2, 60)}</p>", f'<li class="comment">{say(2, 60)}</li>'])
        return f"<{tag}{more} {off}>{rng.choice(['', f'<h3>{say(1, 3)}</h3>', f'<h2>{say(1, 2)}</h2>'])}{''.join(one() for _ in range(rng.randint(1, 4)))}</{tag}>"

    pages = []
    for _ in range(n):
        tag, more = rng.choice([("article", "")] * 4 + [("main", ""), ("article", ' class="post"'), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="article-body"'), ("div", ' class="post entry"'), ("section", ' class="story"'), ("div", ' role="main"'), ("div", ' class="main text"')])
        body = f'<{tag}{more} data-content-label="1">{article()}{boilerplate("comments") if rng.random() < 0.15 else ""}</{tag}>'
        if rng.random() < 0.15:
            body = f'<main data-content-label="1">{body}</main>'
        before = [boilerplate(k) for k in ("header", "nav", "notice", "ad") if rng.random() < 0.45]
        after = [boilerplate(k) for k in ("related", "sidebar", "comments", "ad", "newsletter", "form", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        whole = "".join([*before, body, *after])
        if rng.random() < 0.4:
            whole = f'<div class="{rng.choice(["wrapper", "container", "page", "layout", "row"])}">{whole}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title></head><body>{whole}</body></html>")
    return pages


def train(pages: list[str], *, passes: int = 12, rate: float = 0.4, decay: float = 1e-4, seed: int = 3) -> Model:
    """Gradient ascent on the likelihood of the labelled trees; a node without a label has its parent's."""
    data = []
    for page in pages:
        nodes, _ = parse(page)
        truth: dict[int, int] = {}
        for x in nodes:
            truth[id(x)] = x.label if x.label is not None else truth[id(x.parent)] if x.parent is not None else 0
        data.append((nodes, [truth[id(x)] for x in nodes], [features(x) for x in nodes]))
    model, squares = Model(), {}
    rng = random.Random(seed)

    def step(key, value: float, old: float) -> float:
        value -= decay * old
        squares[key] = squares.get(key, 1e-6) + value * value
        return old + rate * value / math.sqrt(squares[key])

    for _ in range(passes):
        rng.shuffle(data)
        for nodes, truth, seen in data:
            weight = model.weight
            probability, pairs = model.marginals(nodes, [sum([weight.get(f, 0.0) for f in fs]) for fs in seen])
            change: dict[str, float] = {}
            for y, p, fs in zip(truth, probability, seen, strict=True):
                if abs(y - p) > 1e-4:
                    for f in fs:
                        change[f] = change.get(f, 0.0) + y - p
            for f, v in change.items():
                weight[f] = step(f, v, weight.get(f, 0.0))
            counts = [0.0] * 4
            at = {id(x): y for x, y in zip(nodes, truth, strict=True)}
            for x, y, q in zip(nodes[1:], truth[1:], pairs[1:], strict=True):
                counts[2 * at[id(x.parent)] + y] += 1
                for k in range(4):
                    counts[k] -= q[k]
            for k in range(4):
                model.pair[k // 2][k % 2] = step(k, counts[k], model.pair[k // 2][k % 2])
    return model


def extract(pages: DataFrame, *, column: str = "html", out: str = "text", model: Model | None = None, training_pages: int = 1500) -> DataFrame:
    """pages with `out`, the main text. The model is a few hundred weights, whatever the pages."""
    trained = model or train(labelled_pages(training_pages))
    shared = pages.sparkSession.sparkContext.broadcast((trained.weight, trained.pair))
    kept = [f for f in pages.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model()
        local.weight, local.pair = shared.value
        for batch in batches:
            texts = [local.text(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string())], names=[*names, out])

    return pages.mapInArrow(run, schema)
