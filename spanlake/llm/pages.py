"""Main text of web pages by a tree-structured graphical model over the block elements of the page.

Each block element is content or not. Node potentials come from its tag, the words in its class, id and role, its
amount of text and its share of links; parent-child potentials connect it to its parent. Sum-product messages up and
down the tree give each element's marginal. The weights are those of the conditional likelihood of labelled pages,
climbed with the same messages. All pages of a batch are one forest, and a level of it is passed at a time in numpy.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements inside a line of text, without content, and never shown as text.
MATH = "math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mfenced mtable mtr mtd mmultiscripts mprescripts none semantics merror"
INLINE = frozenset(f"{MATH} a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr mspace mprescripts none".split())
HIDDEN = frozenset("script style noscript template head title svg annotation annotation-xml iframe object select button textarea canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
#: An opening tag ends these open elements, up to the nearest of the stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: Elements that can stand in a head; any other, and any text, ends it.
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes head".split())
BLOCKS = CLOSES_P | IMPLIED.keys() | {"body", "thead", "caption"}
P_STOPS = frozenset("body html table td th article section div main aside li blockquote".split())

TAGS = "html body nav header footer aside form article main section div p heading list li table cell blockquote pre figure other".split()
_TAG_OF = {f"h{k}": "heading" for k in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), "list") | dict.fromkeys(("dt", "dd"), "li")
_TAG_OF |= dict.fromkeys(("tr", "tbody", "thead", "tfoot"), "table") | dict.fromkeys(("td", "th"), "cell") | {"figcaption": "figure"}
#: Words in class, id and role that page authors use for each kind of block.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar toc", "header": "header masthead banner topbar logo branding",
    "footer": "footer foot copyright colophon contentinfo legal", "sidebar": "sidebar aside complementary rail widget related recommended trending popular",
    "notice": "cookie cookies consent notice alert gdpr modal popup overlay newsletter paywall disclaimer warning", "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "form": "form search login signup subscribe", "comment": "comment comments reply replies discussion disqus respond feedback", "share": "share sharing social follow tags meta author byline",
    "content": "content main article post entry story body text",
}
_KIND_OF = {word: kind for kind, words in WORDS.items() for word in words.split()}
_KINDS = list(WORDS)
_LENGTHS = (1, 5, 15, 40)
_DENSITIES = (0.0, 0.3, 0.7)
N_FEATURES = 1 + len(TAGS) + len(_KINDS) + len(_LENGTHS) + 1 + len(_DENSITIES) + 1 + 3
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Block elements in page order (a parent before its children) and the text runs with their elements."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    kinds: list[frozenset] = field(default_factory=list)
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)  # (element, block, text, inside a link)
    marked: list[str] = field(default_factory=list)  # raw attributes


def _closed(source: str, position: int) -> set[int]:
    """Where the start tags of hidden elements are, from a position on, that have an end tag of their own."""
    opened: dict[str, list[int]] = {}
    out = set()
    while m := _TOKEN.search(source, position):
        position = m.end()
        tag = (m[2] or "").lower()
        if tag in RAW and not m[1]:
            close = _raw_end(tag).search(source, position)
            position = close.end() if close else len(source)
        elif tag in HIDDEN and m[1]:
            if opened.get(tag):
                out.add(opened[tag].pop())
        elif tag in HIDDEN and not m[3].endswith("/"):
            opened.setdefault(tag, []).append(m.start())
    return out


def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*/?>", re.I)


def parse(source: str) -> Page:
    """A forgiving reading of HTML: implied and missing end tags, void and raw elements, comments left out.

    A hidden element ends at its own end tag or with its parent. One that has no end tag also ends where a block begins,
    and a head ends at the first text or element that can't stand in it.
    """
    page = Page(["html"], [-1], [frozenset()], [], [""])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with its block element
    links = block = 0
    hidden: list[tuple[int, bool]] = []  # places on the stack of hidden elements, and whether each has its own end tag
    closed: set[int] | None = None
    position = 0

    def text_to(end: int) -> None:
        if hidden and stack[hidden[0][0]][0] == "head" and len(hidden) == 1 and source[position:end].strip():
            pop_to(hidden[0][0])
        if end > position and not hidden:
            said = html.unescape(source[position:end])
            if said:
                page.runs.append((stack[-1][1], block, said, links > 0))

    def pop_to(k: int) -> None:
        nonlocal links, block
        shown = hidden[0][0] if hidden else len(stack)
        for tag, _ in stack[k:shown]:
            links -= tag == "a"
            block += tag not in INLINE
        del stack[k:]
        while hidden and hidden[-1][0] >= k:
            hidden.pop()

    while True:
        m = _TOKEN.search(source, position)
        if m is None:
            break
        text_to(m.start())
        position = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            close = _raw_end(tag).search(source, position)
            position = close.end() if close else len(source)
            block += tag not in INLINE and not hidden
            continue
        if hidden and tag in BLOCKS and (k := next((k for k, own in hidden if not own), None)) is not None:
            pop_to(k)
        if hidden and stack[hidden[0][0]][0] == "head" and len(hidden) == 1 and tag not in HEAD:
            pop_to(hidden[0][0])
        if tag in HIDDEN:
            if not m[3].endswith("/") and len(stack) < 4000:
                if closed is None and tag != "head":
                    closed = _closed(source, m.start())
                hidden.append((len(stack), tag == "head" or m.start() in closed))
                stack.append((tag, stack[-1][1]))
            continue
        if hidden:
            if tag not in VOID and not m[3].endswith("/") and len(stack) < 4000:
                stack.append((tag, stack[-1][1]))
            continue
        if tag == "br":
            page.runs.append((stack[-1][1], block, " ", links > 0))
            continue
        if tag in VOID:
            block += tag not in INLINE
            continue
        if tag == "html" or (tag == "body" and any(t == "body" for t, _ in stack)):
            continue
        ends, stops = IMPLIED.get(tag, (set(), set()))
        if tag in CLOSES_P:
            ends, stops = ends | {"p"}, stops | P_STOPS - {tag}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends:
                pop_to(k)
                break
            if stack[k][0] in stops:
                break
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
        else:
            block += 1
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if m[3] else ""
            page.tags.append(tag), page.parents.append(stack[-1][1]), page.marked.append(m[3])
            page.kinds.append(frozenset(_KIND_OF[w] for x in _PART.findall(names) if (w := x.lower()) in _KIND_OF) if names else frozenset())
            stack.append((tag, len(page.tags) - 1))
        if len(stack) > 2000:  # deeper nesting stays on this level
            pop_to(2000)
    text_to(len(source))
    return page


@dataclass
class Forest:
    """Pages as one forest: features, parents, depth and whether an edge enters a section of its own kind."""

    x: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray


_SECTIONS = frozenset("nav header footer aside form article main section".split())


def forest(pages: list[Page]) -> Forest:
    total = sum(len(p.tags) for p in pages)
    x = np.zeros((total, N_FEATURES), np.float32)
    parent, depth, edge = np.full(total, -1), np.zeros(total, int), np.zeros(total, int)
    base = 0
    for page in pages:
        n = len(page.tags)
        words, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n, int)
        for element, _, text, link in page.runs:
            count = len(text.split())
            words[element] += count
            linked[element] += count * link
            stops[element] += count > 0 and text.rstrip()[-1:] in ".!?;:"
        for k in range(n - 1, 0, -1):
            words[page.parents[k]] += words[k]
            linked[page.parents[k]] += linked[k]
            stops[page.parents[k]] += stops[k]
        inside = np.zeros(n, bool)
        for k in range(n):
            tag, at = page.tags[k], base + k
            column = 1
            x[at, 0] = 1
            named = _TAG_OF.get(tag, tag)
            x[at, column + (TAGS.index(named) if named in TAGS else len(TAGS) - 1)] = 1
            column += len(TAGS)
            for kind in page.kinds[k]:
                x[at, column + _KINDS.index(kind)] = 1
            column += len(_KINDS)
            x[at, column + int(np.searchsorted(_LENGTHS, words[k], "right"))] = 1
            column += len(_LENGTHS) + 1
            x[at, column + int(np.searchsorted(_DENSITIES, linked[k] / max(words[k], 1), "left"))] = 1
            column += len(_DENSITIES) + 1
            p = page.parents[k]
            if p >= 0:
                parent[at], depth[at] = base + p, depth[base + p] + 1
                inside[k] = inside[p] or page.tags[p] in ("article", "main")
                edge[at] = 2 if tag in ("article", "main") and not page.kinds[k] else 1 if tag in _SECTIONS or page.kinds[k] else 0
            x[at, column], x[at, column + 1], x[at, column + 2] = inside[k], stops[k] > 0, inside[k] and tag == "header"
        base += n
    return Forest(x, parent, depth, edge)


@dataclass
class Model:
    """Node weights (for content against not) and the log potentials of (parent, child) labels by kind of edge."""

    node: np.ndarray
    pair: np.ndarray


def marginals(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each node and P(parent label, own label) of each node's edge, by sum-product on the forest."""
    n = len(f.parent)
    unary = np.zeros((n, 2))
    unary[:, 1] = f.x @ model.node
    up, message = unary.copy(), np.zeros((n, 2))
    levels = [np.flatnonzero(f.depth == d) for d in range(1, int(f.depth.max(initial=0)) + 1)]
    pair = model.pair[f.edge]
    for rows in reversed(levels):
        m = np.logaddexp(pair[rows, :, 0] + up[rows, None, 0], pair[rows, :, 1] + up[rows, None, 1])
        message[rows] = m - m.max(axis=1, keepdims=True)
        np.add.at(up, f.parent[rows], message[rows])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for rows in levels:
        outside = belief[f.parent[rows]] - message[rows]
        both = outside[:, :, None] + pair[rows] + up[rows, None, :]
        joint[rows] = both - both.max(axis=(1, 2), keepdims=True)
        belief[rows] = np.logaddexp(both[:, 0, :], both[:, 1, :])
        belief[rows] -= belief[rows].max(axis=1, keepdims=True)
    probability = np.exp(belief - belief.max(axis=1, keepdims=True))
    joint = np.exp(joint)
    return probability / probability.sum(axis=1, keepdims=True), joint / joint.sum(axis=(1, 2), keepdims=True)


def fit(labelled: list[tuple[Page, list[int]]], steps: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Weights from pages whose elements are labelled 1 (content) or 0. The pages are held here, so give a bounded set."""
    f = forest([p for p, _ in labelled])
    y = np.concatenate([np.array(labels) for _, labels in labelled])
    model = Model(np.zeros(N_FEATURES), np.zeros((3, 2, 2)))
    has = f.parent >= 0
    seen_pair = np.zeros((3, 2, 2))
    np.add.at(seen_pair, (f.edge[has], y[f.parent[has]], y[has]), 1)
    seen_node = f.x.T @ y
    speed_n, speed_p = np.zeros(N_FEATURES), np.zeros((3, 2, 2))
    for _ in range(steps):
        p, joint = marginals(f, model)
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, f.edge[has], joint[has])
        gn = (seen_node - f.x.T @ p[:, 1]) / len(y) - ridge * model.node
        gp = (seen_pair - expected) / len(y) - ridge * model.pair
        speed_n, speed_p = speed_n + gn**2, speed_p + gp**2
        model.node += rate * gn / np.sqrt(speed_n + 1e-12)
        model.pair += rate * gp / np.sqrt(speed_p + 1e-12)
    return model


_MARK = 'data-main="1"'


def labelled_pages(count: int = 500, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Pages made by rule, in layouts of many kinds, whose content elements carry a mark that the features do not see."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="#">{words(1, 2)}</a></li>' for _ in range(r.randint(a, b)))
    name = lambda *kinds: r.choice(['class="{}"', 'id="{}"', 'class="x-{} y"']).format(r.choice(" ".join(WORDS[k] for k in kinds).split()))

    def block() -> str:
        kind = r.choice("ppppppphltqdfa")
        m = _MARK
        said = words(*r.choice([(1, 4), (5, 30), (20, 90)])) + r.choice([".", ".", ".", "", "!!", " |"])
        return {
            "p": f"<p {m}>{said}</p>", "h": f"<h{r.randint(2, 4)} {m}>{words(1, 6)}</h2>", "l": f"<ul {m}>" + "".join(f"<li {m}>{words(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
            "t": f"<table {m}><tr {m}><td {m}>{words(1, 4)}</td><td {m}>{words(1, 4)}</td></tr></table>", "q": f"<blockquote {m}><p {m}>{said}</p></blockquote>",
            "d": f"<div {m}>{said}</div>", "f": f"<figure {m}><figcaption {m}>{words(2, 9)}</figcaption></figure>", "a": f'<p {m}>{said} <a href="#">{words(1, 3)}</a> {words(0, 9)}</p>',
        }[kind]

    def around(kind: str) -> str:
        short, text = words(1, 9), words(5, 40) + "."
        return {
            "nav": r.choice([f"<nav><ul>{links(2, 9)}</ul></nav>", f"<div {name('menu')}><ul>{links(2, 9)}</ul></div>", f"<ul {name('menu')}>{links(2, 6)}</ul>"]),
            "header": r.choice([f"<header><h1>{short}</h1><p>{words(1, 8)}</p></header>", f"<div {name('header')}>{short}</div>", f"<header><nav><ul>{links(1, 4)}</ul></nav></header>"]),
            "footer": r.choice([f"<footer>&copy; {short} {text}</footer>", f"<footer><p>{text}</p><ul>{links(1, 4)}</ul></footer>", f"<div {name('footer')}><p>{text}</p></div>"]),
            "side": r.choice([f"<aside><h3>{short}</h3><ul>{links(1, 6)}</ul></aside>", f"<aside><p>{text}</p></aside>", f"<div {name('sidebar')}><h3>{short}</h3><p>{text}</p></div>"]),
            "ad": f"<div {name('advert')}>{r.choice([short, text, f'<p>{text}</p>'])}</div>", "notice": f"<div {name('notice')}>{r.choice([f'<p>{text}</p>', text])}</div>",
            "form": r.choice([f'<form><p>{short}</p><input name="q"></form>', f"<form {name('form')}><div>{short}</div></form>"]),
            "comments": r.choice([f"<section {name('comment')}><h2>{short}</h2>" + "".join(f"<{t} {name('comment')}><p>{words(3, 60)}.</p></{t}>" for t in r.choices(["article", "div"], k=r.randint(1, 4))) + "</section>",
                                  f"<div {name('comment')}><ul>" + "".join(f"<li><p>{words(3, 40)}.</p></li>" for _ in range(r.randint(1, 3))) + "</ul></div>"]),
            "share": f"<div {name('share')}>{short}</div>",
        }[kind]

    out = []
    for _ in range(count):
        inner = "".join(block() for _ in range(r.choice([1, 1, 1, 2, 3, 5, 9, 14])))
        title = r.choice([f"<h1 {_MARK}>{words(1, 9)}</h1>", f"<header {_MARK}><h1 {_MARK}>{words(1, 9)}</h1></header>", ""])
        extra = "".join(around(k) for k in r.sample(["ad", "side", "form", "share", "comments", "notice"], r.choice([0, 0, 0, 1, 2])))
        cut = r.randint(0, 1)
        body = f"{title}{extra if cut else ''}{inner}{'' if cut else extra}"
        m = _MARK
        main = r.choice([f"<article {m}>{body}</article>"] * 3 + [f"<main {m}>{body}</main>", f"<main {m}><article {m}>{body}</article></main>", f"<div {m} {name('content')}>{body}</div>", f"<section {m}>{body}</section>", f"<main {m}><div {m}>{body}</div></main>", f"<div {m} {name('content')}><div {m}>{body}</div></div>"])
        before = "".join(around(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.5)
        after = "".join(around(k) for k in ("side", "comments", "ad", "notice", "footer") if r.random() < 0.5)
        shell = r.choice(["{}{}{}", "<div>{}{}{}</div>", '<div class="page">{}{}{}</div>'])
        bare = r.random() < 0.1
        page = parse(r.choice([inner, f"<html><body>{inner}</body></html>", f"{words(1, 40)}<br>{words(1, 20)}"]) if bare else f"<html><body>{shell.format(before, main, after)}</body></html>")
        own = {element for element, _, text, _ in page.runs if bare and text.strip()}  # a bare page is content where it has text
        out.append((page, [int(_MARK in m or k in own) for k, m in enumerate(page.marked)]))
    return out


_SPACE = re.compile(r"\s+")


def main_texts(sources: list[str | None], model: Model, least: float = 0.5) -> list[str]:
    """Main text of each page: the blocks of elements that are content with probability ``least`` or more."""
    pages = [parse(s or "") for s in sources]
    if not pages:
        return []
    probability = marginals(forest(pages), model)[0][:, 1]
    out, base = [], 0
    for page in pages:
        blocks: list[str] = []
        current, parts = None, []
        for element, block, text, _ in page.runs:
            if probability[base + element] < least:
                continue
            if block != current:
                blocks.append("".join(parts))
                current, parts = block, []
            parts.append(text)
        blocks.append("".join(parts))
        clean = (_SPACE.sub(" ", b).strip() for b in blocks)
        out.append("\n".join(b for b in clean if b))
        base += len(page.tags)
    return out


def extract_main_text(pages: DataFrame, model: Model | None = None, html_column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole html: an empty text where there is none, or for null and empty html.

    Without a ``model`` (from ``fit`` on labelled pages) one is trained on ``labelled_pages()``. Other columns stay.
    """
    model = model or fit(labelled_pages())
    rest = [F.col(c) for c in pages.columns if c != into]

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            values, out, held, size = column.tolist(), [], [], 0
            for value in values:
                held.append(value)
                size += len(value or "")
                if size > 1 << 20:
                    out += main_texts(held, model)
                    held, size = [], 0
            yield pd.Series(out + main_texts(held, model), dtype=object)

    return pages.select(*rest, extracted(F.col(html_column).cast("string")).alias(into))
