"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node that is content or not. A parent-child potential says how
likely the child is content beside its parent's state, from the child's tag, its class and
id words and its own text. Sum-product messages pass from the leaves up and from the root
down, which gives each node's exact marginal. The weights maximise the likelihood of
labelled pages; the gradient of that comes from the same messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape, unescape
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Elements of HTML by how they are read (fixed values). What is in none of them is inline.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style textarea title template iframe noframes select".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
BLOCK = CLOSES_P | set("html head body button caption colgroup dd dt legend li noscript tbody td tfoot th thead tr".split())
#: A cut-off tag without attributes counts as a tag if its name is one of these.
KNOWN = BLOCK | VOID | UNSEEN | {"span", "strong", "em"}
#: What an open element of the first kind is closed by: its own kind, up to the container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

#: A tag's quotes open only after =; a comment may end where it starts; a tag that meets the next < ends there.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:=\s*\"[^\"]*+\"|=\s*'[^']*+'|[^<>])*+)(>|$|(?=<))", re.S)
ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]\S*)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
BODY = re.compile(r"<body[\s>]", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

#: Hand-labelled parts of pages that the model is trained on: data-main marks elements whose
#: subtree is content, data-off those inside that are not; each ~ stands for a sentence.
MAINS = [
    "<article data-main><h1>Title of it</h1><p>~~~</p><p>~~<b>~</b> and <a href='/x'>a link</a>.</p></article>",
    "<main data-main><h1>Title</h1><p>~~</p><ul><li>~</li><li>point two</li></ul><h2>Part</h2><p>~~~</p><ol><li>one</li><li>two</li></ol></main>",
    "<div id='content' data-main><h1>Title</h1><p>~~~</p><blockquote><p>~~</p></blockquote><div class='ad advert' data-off><p>~~</p></div><p>~~</p></div>",
    "<div class='post-content entry' data-main><h1>Title</h1><div><p>~~~</p><p>~~</p></div><pre>~</pre><table><tr><th>h</th><td>v</td></tr></table><figure><figcaption>~</figcaption></figure></div>",
    "<article data-main><ul><li>one</li><li>two</li><li>~</li></ul></article>",
    "<article data-main><table><tr><th>name</th><th>n</th></tr><tr><td>~</td><td>1</td></tr></table></article>",
    "<article class='article story text' data-main><header class='entry'><h1>Title</h1><p>~</p></header><section><h2>Part</h2><p>~~~</p></section><section><p>~~~</p><dl><dt>term</dt><dd>~</dd></dl></section><aside class='share' data-off><ul><li><a href='/s'>Share</a></li></ul></aside></article>",
    "<main class='main' data-main><article class='body'><h1>Title</h1><p>~~~</p><p>Short one.</p><h3>Sub</h3><p>~~</p></article><section class='comments' data-off><h2>Comments</h2><ul><li class='comment'><p>~~</p></li><li class='comment'><p>~~~</p></li></ul></section></main>",
    "<main data-main><p>~~~</p><p>~~~</p><div class='comment' data-off><p>~~~</p><p>~~~~</p></div><div class='comment reply' data-off>~~</div></main>",
    "<div class='main'><div class='content' data-main><h2>Title</h2><p>~~</p><p>~~~~</p><nav class='toc' data-off><ul><li><a href='/1'>~</a></li></ul></nav><p>~</p></div><div class='side column menu' data-off><ul><li><a href='/1'>~</a></li></ul></div></div>",
    "<article data-main><h1>Title</h1><p>~~</p><form data-off><label>Mail</label><p>~</p><button>Send</button></form><p>~~</p></article>",
    "<div class='page'><div><div data-main><p>~~~</p><p>~~</p><p>~</p></div></div></div>",
    "<table class='layout'><tr><td class='menu' data-off><a href='/1'>One</a><a href='/2'>Two</a></td><td data-main><h1>Title</h1><p>~~~</p><p>~</p></td></tr></table>",
    "<article data-main><p>Short.</p></article>",
    "<main data-main><p>~</p></main>",
    "<section class='story' data-main><h2>Title</h2>~~<p>~~</p><div class='box promo newsletter' data-off><p>~</p></div><p>~</p></section>",
    "<article data-main><h1>Title</h1><p>~~~</p><figure><figcaption>~</figcaption></figure><footer data-off><p>~</p></footer></article>",
    "<div class='row'><div class='col' data-main><h1>Title</h1><p>~~~</p><p>~</p></div><div class='col' data-off><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div></div>",
    "<div class='u'><div class='v'><div data-main>~~~</div></div></div>",
    "<div><div><div data-main>~~</div></div></div><div data-off><a href='/1'>One</a> <a href='/2'>Two</a></div>",
    "<div data-off><a href='/1'>One</a></div><div data-main><p>~~</p></div><div data-off><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div>",
    "<div data-main><h1>Title</h1><p>~~</p><p>~</p></div><div data-off><ul><li><a href='/1'>~</a></li><li><a href='/2'>~</a></li></ul></div>",
    "<div data-off><ul><li><a href='/1'>~</a></li><li><a href='/2'>~</a></li></ul></div><div><div data-main>~~~<p>~~</p></div></div>",
    "<article data-main><p>~~<button data-off>Share this</button></p><button data-off>More</button><p>~</p></article>",
    "<div data-main><p>~~</p><p>~ <button data-off>Send</button></p></div>",
    "<article data-main><p>~~</p><ul><li><a href='/1'>~</a></li><li>~</li></ul><p>~ <a href='/2'>a link</a></p></article>",
    "<article data-main><h1>Title</h1><p>~~</p><h2>Links</h2><ul><li><a href='/1'>One of them</a></li><li><a href='/2'>Two of them</a></li></ul></article>",
    "<td data-off><a href='/1'>One</a></td><div data-main>~<div>~~</div><div>~</div></div>",
    "<div class='x'><div class='y' data-main><h2>Title</h2><div>~~</div><div>~</div></div><div class='z' data-off><div><a href='/1'>One</a></div><div><a href='/2'>Two</a></div></div></div>",
    "<section data-main><p>~~</p></section><section data-off><h3>More</h3><p><a href='/1'>~</a></p><p><a href='/2'>~</a></p></section>",
    "<div class='article' data-main><dl><dt>term</dt><dd>~</dd><dt>term</dt><dd>~~</dd></dl><pre>~</pre></div>",
]
#: Content that stands right in the body.
BARE = ["<p>~</p>", "<p>~~</p>~~<div>~~~</div><div>~~</div>", "<h1>Title</h1><p>~~</p><p>~~~</p><p>~~~</p>", "~~", "<h1>Title</h1><ul><li>~</li><li>two</li></ul>", "<div>~</div>", "<h2>Title</h2><table><tr><td>~</td><td>2</td></tr></table><p>~~</p>", "few words", "<h1>Title</h1><p>Short one.</p>", "<p>Short one.</p><p>~</p>"]
#: What stands around it, before and after.
AROUND = [
    ("<header class='site-header' data-off><a href='/'>Site</a><nav class='menu'><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav></header>", "<aside class='sidebar' data-off><h3>Related</h3><ul><li><a href='/r'>R</a></li><li><a href='/q'>~</a></li></ul><p>~</p></aside><footer class='footer' data-off><p>~</p></footer>"),
    ("<nav data-off><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><div class='ad' data-off>~~</div>", "<footer data-off>~~</footer>"),
    ("<div id='cookie-notice' class='notice banner' data-off><p>~~</p><button>Accept</button></div><div id='header' data-off><h2>Site</h2></div>", "<div id='comments' class='comments' data-off><h3>Comments</h3><div class='comment'><p>~~~</p></div><div class='comment reply'><p>~~</p></div><form><label>Name</label><p>~</p></form></div><div id='footer' data-off><p>~</p></div>"),
    ("<div class='navbar' data-off><a href='/a'>One</a><a href='/b'>Two</a></div>", "<div class='sidebar widget' data-off><p>~~</p></div><div class='advert sponsored promo' data-off><p>~</p></div><section class='related share social' data-off><p>~</p><a href='/z'>Z</a></section>"),
    ("", ""),
    ("<header data-off><h1>Name of the site</h1><p>~</p></header><section class='newsletter subscribe popup' data-off><p>~</p><form><button>Go</button></form></section>", "<section id='reader-comments' class='responses replies disqus' data-off><article class='comment'><p>~~</p></article><article class='comment'><p>~~~</p></article></section><aside class='alert warning gdpr consent modal' data-off><p>~</p></aside><footer class='copyright legal' data-off><nav><a href='/t'>Terms</a></nav></footer>"),
    ("<ul class='breadcrumb pagination tags' data-off><li><a href='/1'>1</a></li></ul>", "<div class='ads banner' data-off>~</div><div class='search login signup' data-off><form><label>L</label></form></div>"),
    ("<div class='notice' role='alert' data-off><p>~</p></div><div class='header masthead top' data-off><a href='/'>Site</a></div>", "<div class='recommended popular trending' data-off><a href='/u'>~</a></div><div class='bottom footer colophon' data-off>~</div>"),
    ("<div class='cookie consent' data-off>~<button>OK</button></div><nav data-off></nav>", "<aside data-off><p>~~</p></aside><div class='comment-list' data-off><div class='comment'>~~</div></div><footer data-off><div>~</div><div>~</div></footer>"),
]
SENTENCE = "Here stands a sentence with some ten words in it. "


def labelled_pages() -> list[str]:
    """Every part of MAINS and BARE alone and in three surroundings."""
    pages = []
    for k, part in enumerate(MAINS + BARE):
        bare = " data-main" if k >= len(MAINS) else ""
        for j in range(4):
            before, after = AROUND[(2 * k + 3 * j + 1) % len(AROUND)] if j < 3 else ("", "")
            inner = f"{before}{part}{after}"
            pages.append(f"<html><head></head><body{bare}>{inner if bare or j != 1 else f'<div class=wrapper>{inner}</div>'}</body></html>".replace("~", SENTENCE))
    return pages


@dataclass
class Node:
    tag: str
    words: frozenset
    parent: int
    label: str
    size: int = 0  # characters of its own text
    linked: int = 0  # those of them inside links
    total: int = 0  # characters of all text below it
    total_linked: int = 0


def attributes_of(tag: str) -> dict[str, str]:
    """Names and values of a tag's attributes; the first of a name holds."""
    found: dict[str, str] = {}
    for a in ATTRIBUTE.finditer(tag):
        found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    """By an attribute of that name or a style, never by a word inside another value."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(NOT_SHOWN.search(attributes.get("style", "")))


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order with their parents (block elements only), and blocks of text: (element, text).

    Inline elements and unknown ones do not part blocks; an end tag closes up to its start,
    one without start is ignored. Hidden elements are left out with all that they hold. A <
    that starts no tag is text, as is one before words without values that no > follows
    (a<b and so). Time is linear in the page: the last open element of each tag is known.
    """
    nodes, blocks_, open_, text = [Node("#root", frozenset(), -1, "")], [], [0], []
    places: dict[str, list[int]] = {}
    if not BODY.search(html):  # implied
        nodes.append(Node("body", frozenset(), 0, ""))
        open_.append(1)
        places["body"] = [1]
    position = 0
    shut = None  # depth of the hidden element that is open
    link = None  # depth of elements at which a link was opened
    linked = 0  # characters of links in ``text``

    def say(part: str):
        nonlocal linked
        text.append(part)
        if link is not None:
            linked += len(part.strip())

    def flush():
        nonlocal linked
        if text:
            if shut is None:
                blocks_.append((open_[-1], "".join(text), linked))
            text.clear()
        linked = 0

    def close_to(depth: int):
        nonlocal shut, link
        if depth < len(open_):
            flush()
            while len(open_) > depth:
                places[nodes[open_.pop()].tag].pop()
            if shut is not None and depth <= shut:
                shut = None
            if link is not None and depth < link:
                link = None

    def last(kinds) -> int:
        return max((p[-1] for k in kinds if (p := places.get(k))), default=0)

    def depth_of(kinds, stop) -> int:
        d = last(kinds)
        return d if d > last(stop) else len(open_)

    for m in TOKEN.finditer(html):
        if m.start() < position:
            continue
        if m.start() > position:
            say(html[position : m.start()])
        position = m.end()
        if m[2] is None:
            continue
        end, tag, inner = m[1], m[2].lower(), m[3] or ""
        if not m[4] and m.end() < len(html) and not (tag in KNOWN if not inner.strip() else "=" in inner):
            say(m[0])
            continue
        if end:
            if tag == "br":
                text.append(" ")
            elif tag in BLOCK:
                close_to(depth_of((tag,), ()))
            elif tag == "a":
                link = None
            continue
        if tag in UNSEEN:
            position = _after(html, tag, position)
            if tag in ("title", "textarea"):
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                text.append(" " if tag != "wbr" else "")
            else:
                flush()
            continue
        if tag not in BLOCK:
            if tag == "a":
                link = len(open_) if "href" in attributes_of(inner) else None
            continue
        if tag in CLOSES_P:
            close_to(depth_of(("p",), ("table", "button")))
        if tag in SIBLINGS:
            kinds, stop = SIBLINGS[tag]
            while (d := depth_of(kinds, stop)) < len(open_):
                close_to(d)
        flush()
        attributes = attributes_of(inner)
        if shut is None:
            words = frozenset(w for a in ("class", "id", "role") for w in WORD.findall(attributes.get(a, "").lower()))
            nodes.append(Node(tag, words, open_[-1], "main" if "data-main" in attributes else "off" if "data-off" in attributes else ""))
        else:
            nodes.append(Node(tag, frozenset(), open_[-1], ""))
        if tag == "xmp":  # shown as it is written
            close = _after(html, tag, position)
            open_.append(len(nodes) - 1)
            places.setdefault(tag, []).append(len(open_) - 1)
            say(escape(re.sub(r"(?i)</xmp[^>]*>?$", "", html[position:close])))
            position = close
            close_to(len(open_) - 1)
        elif not inner.rstrip().endswith("/") or tag in CLOSES_P:
            open_.append(len(nodes) - 1)
            places.setdefault(tag, []).append(len(open_) - 1)
            if shut is None and is_hidden(attributes):
                shut = len(open_) - 1
    if position < len(html):
        say(html[position:])
    flush()
    found = [(owner, text, n) for owner, t, n in blocks_ if (text := SPACE.sub(" ", unescape(t)).strip())]
    for owner, t, n in found:
        nodes[owner].size += len(t)
        nodes[owner].linked += min(n, len(t))
    for n in reversed(nodes):  # children come after their parents
        n.total += n.size
        n.total_linked += n.linked
        if n.parent >= 0:
            nodes[n.parent].total += n.total
            nodes[n.parent].total_linked += n.total_linked
    return nodes, [(owner, t) for owner, t, _ in found]


def _after(html: str, tag: str, position: int) -> int:
    """Where the content of an element that holds no elements ends, its end tag included."""
    close = re.compile(f"</{tag}(?![a-z0-9])[^>]*>?", re.I).search(html, position)
    return close.end() if close else len(html)


def features_of(n: Node) -> list[str]:
    """Tag, class and id words, how much text of its own a node has and all below it, linked or not."""
    out = ["*", n.tag, *("." + w for w in n.words)]
    if n.size:
        out.append("#linked" if 2 * n.linked > n.size else "#short" if n.size < 40 else "#text" if n.size < 120 else "#long")
    out.append("%none" if not n.total else "%linked" if 2 * n.total_linked > n.total else "%short" if n.total < 100 else "%long")
    return out


@dataclass
class Model:
    """Weights of each feature of a child: if it is content, if it starts content (its parent is none), if it ends content."""

    weights: dict[str, tuple[float, float, float]]

    def potentials(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """Log potentials of (parent, child) for (no, yes), (yes, no) and (yes, yes), over those of (no, no)."""
        out, none = [(0.0, 0.0, 0.0)], (0.0, 0.0, 0.0)
        for n in nodes[1:]:
            own = [self.weights.get(f, none) for f in features_of(n)]
            inside = sum(w[0] for w in own)
            out.append((inside + sum(w[1] for w in own), sum(w[2] for w in own), inside))
        return out

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content, by sum-product up and down the tree; the root is none."""
        pair, n = self.potentials(nodes), len(nodes)
        below = [[0.0, 0.0] for _ in nodes]  # log weights of a node's states from below
        up = [(0.0, 0.0)] * n  # message to the parent, by the parent's state
        for i in range(n - 1, 0, -1):  # children come after their parents
            (e01, e10, e11), (a0, a1), above = pair[i], below[i], below[nodes[i].parent]
            up[i] = m0, m1 = _add(a0, e01 + a1), _add(e10 + a0, e11 + a1)
            above[0] += m0
            above[1] += m1
        belief, out = below, [0.0] * n
        belief[0][1] = belief[0][0] - 1e6
        for i in range(1, n):  # what a node knows from below, then also from above
            (e01, e10, e11), (m0, m1), (b0, b1), own = pair[i], up[i], belief[nodes[i].parent], belief[i]
            p0, p1 = b0 - m0, b1 - m1
            own[0] += _add(p0, p1 + e10)
            own[1] += _add(p0 + e01, p1 + e11)
            d = own[0] - own[1]
            out[i] = 1 / (1 + exp(d)) if d < 700 else 0.0
        return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


@lru_cache(maxsize=4)
def train(pages: tuple[str, ...] | None = None, penalty: float = 0.02, steps: int = 300) -> Model:
    """Weights of most likelihood over labelled pages, less a penalty on their squares, by gradient ascent.

    The pages are one forest whose messages pass level by level.
    """
    parent, state, found = [], [], []
    for page in pages or labelled_pages():
        nodes, _ = parse(page)
        first = len(parent)
        for n in nodes:
            parent.append(n.parent + first if n.parent >= 0 else -1)
            state.append(0 if n.parent < 0 else {"main": 1, "off": 0}.get(n.label, state[parent[-1]]))
            found.append(features_of(n) if n.parent >= 0 else [])
    names = sorted({f for fs in found for f in fs})
    at = {f: k for k, f in enumerate(names)}
    child, feature = (np.array(x) for x in zip(*((i, at[f]) for i, fs in enumerate(found) for f in fs), strict=True))
    parent, state = np.array(parent), np.array(state)
    depth = np.zeros(len(parent), np.int64)
    for i in np.flatnonzero(parent >= 0):
        depth[i] = depth[parent[i]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    above = np.where(parent >= 0, state[parent], 0)
    real = parent >= 0
    total = lambda x: np.bincount(feature, weights=x[child], minlength=len(names))
    seen = np.stack([total(state * real), total(state * (1 - above) * real), total((1 - state) * above * real)])
    w, mean, square = np.zeros((3, len(names))), 0.0, 0.0
    for step in range(1, steps + 1):
        inside, start, stop = (np.bincount(child, weights=k[feature], minlength=len(parent)) for k in w)
        pair = np.zeros((len(parent), 2, 2))
        pair[:, 0, 1], pair[:, 1, 0], pair[:, 1, 1] = inside + start, stop, inside
        below, up = np.zeros((len(parent), 2)), np.zeros((len(parent), 2))
        for level in reversed(levels):
            up[level] = np.logaddexp(pair[level, :, 0] + below[level, None, 0], pair[level, :, 1] + below[level, None, 1])
            np.add.at(below, parent[level], up[level])
        belief = below.copy()
        belief[~real, 1] = -1e6
        joint = np.zeros((len(parent), 2, 2))
        for level in levels:
            rest = belief[parent[level]] - up[level]
            both = rest[:, :, None] + pair[level] + below[level, None, :]
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        expected = np.stack([total(joint[:, :, 1].sum(1)), total(joint[:, 0, 1]), total(joint[:, 1, 0])])
        slope = seen - expected - penalty * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        w = w + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model({f: tuple(w[:, k].tolist()) for f, k in at.items()})


def main_text(html: str | None, model: Model) -> str:
    nodes, found = parse((html or "").replace("\0", ""))
    if not found:
        return ""
    p = model.marginals(nodes)
    return "\n".join(text for owner, text in found if p[owner] > 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Main text of every whole page: (id, the columns of ``keep``, text, n_chars long in code points).

    Null and empty pages and pages without content have empty text and 0 characters. Cut-off
    pages are read as far as they go. Repeated rows give repeated results, an empty table
    none; other columns are not read. No shuffle; memory is one block of pages.
    """
    kinds = {f"_{i}": pages.schema[c].dataType.simpleString() for i, c in enumerate((id_col, *keep))}

    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            texts = [main_text(h, model) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kinds), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kinds, "text", "n_chars"])

    rows = pages.select(*(F.col(c).alias(k) for k, c in zip(kinds, (id_col, *keep), strict=True)), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", text string, n_chars long")
    return out.select(*(F.col(k).alias(c) for k, c in zip(kinds, (id_col, *keep), strict=True)), "text", "n_chars")
