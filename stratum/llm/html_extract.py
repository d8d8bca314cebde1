"""Main text of web pages by gradient-boosted trees over the nodes of their DOM.

Every block-level node gets features of its subtree (length, link and tag density, punctuation, paragraphs), its place
(depth, siblings, position in the page) and its tag and attribute tokens, and those of its ancestors. Boosted trees
give each node the log odds of being main text. A dynamic programme over the tree then decides for each node to keep
its whole subtree, drop it, or leave the decision to its children, so that no choice contradicts one above it.

The trees are trained here, on pages of many layouts written by ``training_pages``, where the main text is known.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl html body article section div td th select".split())

_TAG_NAME = re.compile(r"</?[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_QUOTE_OR_END = re.compile("[>\"']")
_NAMED = re.compile(r"""(?:^|\s)(?:id|class|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.,;:!?。，](?:\s|$)")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "own", "link", "marks", "depth", "first", "logit")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.own = self.link = self.marks = 0
        self.depth = parent.depth + 1 if parent else 0
        self.first = 0.0
        self.logit = 0.0


class _Finder:
    """The next match of a pattern, searched once for all places before it."""

    def __init__(self, pattern: re.Pattern, source: str):
        self.pattern, self.source = pattern, source
        self.after, self.found = 0, -1

    def __call__(self, at: int) -> int:
        """Where the next match starts, or the end of the source."""
        if not self.after <= at <= self.found:
            match = self.pattern.search(self.source, at)
            self.after, self.found = at, match.start() if match else len(self.source)
        return self.found


class _Markup:
    """Markup of a page, one piece after the other, in time linear in its length whatever is left open."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.name_end, self.mark = _Finder(_NAME_END, source), _Finder(_QUOTE_OR_END, source)
        self.open_quotes: set[int] = set()  # quotes from which no end of a tag can be reached
        self.unclosed: set[str] = set()  # raw elements with no closing tag in what is left

    def tag_end(self, at: int) -> int:
        """The ``>`` that ends the tag whose attributes start at ``at``, quoted strings passed over; -1 if there is none."""
        passed = []
        while (at := self.mark(at)) < len(self.source) and at not in self.open_quotes:
            if self.source[at] == ">":
                return at
            passed.append(at)
            close = self.source.find(self.source[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.open_quotes.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, kind, name and attributes of the next piece of markup; kinds are ``<``, ``/``, ``!`` and ``[``."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at) or source.startswith("<![CDATA[", at):
                kind, close = ("!", "-->") if source[at + 2] == "-" else ("[", "]]>")
                end = source.find(close, at + (4 if kind == "!" else 9))
                return (at, end + 3, kind, "", source[at + 9 : end]) if end >= 0 else (at, len(source), kind, "", source[at + 9 :])
            if at < self.last:
                if source[at + 1] in "!?":
                    return at, source.index(">", at) + 1, "!", "", ""
                if _TAG_NAME.match(source, at):
                    closing = source[at + 1] == "/"
                    name_end = self.name_end(at + 1 + closing)
                    end = self.tag_end(name_end)
                    if end >= 0:
                        return at, end + 1, "/" if closing else "<", source[at + 1 + closing : name_end].lower(), source[name_end:end]
            at += 1
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the closing tag of a raw element ends; -1 if it has none."""
        if tag not in self.unclosed:
            close = re.compile(f"</{re.escape(tag)}\\b", re.I).search(self.source, at)
            end = self.source.find(">", close.end()) if close else -1
            if end >= 0:
                return end + 1
            self.unclosed.add(tag)
        return -1


def parse(source: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block-level nodes in page order, and pieces of text with the node that holds each; a space parts blocks.

    What looks like a tag but never ends is text. Scripts and styles that are never closed go on to the end of the page;
    other raw elements that aren't are passed over as if they were closed at once.
    """
    root = Node("", "", None)
    nodes, pieces = [root], []
    stack = [root]
    is_open: Counter[str] = Counter()
    links, at = 0, 0
    length = len(source)
    markup = _Markup(source)

    def text(raw: str) -> None:
        piece = html.unescape(raw) if "&" in raw else raw
        node = stack[-1]
        n = len(piece) - piece.count(" ")
        if n:
            node.own += n
            node.marks += len(_SENTENCE.findall(piece))
            if links:
                node.link += n
        pieces.append((node, piece))

    def pop_to(index: int) -> None:
        is_open.subtract(x.tag for x in stack[index:])
        del stack[index:]
        pieces.append((stack[-1], " "))

    while at < length:
        found = markup.next(at)
        if not found:
            text(source[at:])
            break
        begin, end, kind, tag, attrs = found
        if begin > at:
            text(source[at:begin])
        at = end
        if kind in "![":
            if kind == "[":
                text(attrs.replace("&", "&amp;"))
            continue
        closing = kind == "/"
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            pieces.append((stack[-1], " "))
            continue
        if closing:
            if is_open[tag] > 0:
                index = len(stack) - 1
                while stack[index].tag != tag:
                    index -= 1
                pop_to(index)
                links = 0
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = markup.raw_end(tag, at)
                at = end if end >= 0 else length if tag in ("script", "style") else at
            continue
        if tag in CLOSES_P and is_open["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in CLOSED_BY and any(is_open[x] > 0 for x in CLOSED_BY[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[tag]:
                    pop_to(i)
                    break
                if stack[i].tag in SCOPE and stack[i].tag not in ("td", "th"):
                    break
        pieces.append((stack[-1], " "))
        if tag in VOID:
            continue
        node = Node(tag, attrs, stack[-1])
        node.first = at / length
        stack[-1].children.append(node)
        nodes.append(node)
        if not attrs.endswith("/"):
            stack.append(node)
            is_open[tag] += 1
    return nodes, pieces


def attribute_tokens(node: Node) -> list[str]:
    if not node.attrs or "=" not in node.attrs:
        return []
    return [t for m in _NAMED.finditer(node.attrs) for t in _TOKEN.findall((m[1] or m[2] or m[3] or "").lower())]


@dataclass
class Model:
    """Trees of a fixed depth in arrays: feature and bound of each inner node, value of each leaf."""

    depth: int = 5
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    bounds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    tags: dict[str, float] = field(default_factory=dict)
    tokens: dict[str, float] = field(default_factory=dict)

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.features[tree][at]] > self.bounds[tree][at])
        return at - ((1 << self.depth) - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in range(len(self.values)):
            out += self.values[tree][self.leaves(x, tree)]
        return out


def node_features(nodes: list[Node], model: Model) -> np.ndarray:
    """A row for each node. Tags and tokens count by their average label in training (0: unknown)."""
    n = len(nodes)
    index = {id(node): i for i, node in enumerate(nodes)}
    parent = np.array([index[id(x.parent)] if x.parent else 0 for x in nodes])
    total, link, marks, tags, paragraphs = (np.array(v, float) for v in ([x.own for x in nodes], [x.link for x in nodes], [x.marks for x in nodes], [1] * n, [x.tag == "p" for x in nodes]))
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        total[p] += total[i]
        link[p] += link[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
    tag_score = np.array([model.tags.get(x.tag, 0.0) for x in nodes])
    scores = [[model.tokens.get(t, 0.0) for t in attribute_tokens(x)] for x in nodes]
    low = np.array([min(s, default=0.0) for s in scores])
    high = np.array([max(s, default=0.0) for s in scores])
    above = np.zeros((n, 4))  # least and greatest of tag and token scores of the ancestors
    sibling, siblings = np.zeros(n), np.ones(n)
    for i, x in enumerate(nodes):
        if i:
            p = parent[i]
            above[i] = (min(above[p, 0], tag_score[p]), max(above[p, 1], tag_score[p]), min(above[p, 2], low[p]), max(above[p, 3], high[p]))
        for j, child in enumerate(x.children):
            k = index[id(child)]
            sibling[k], siblings[k] = j, len(x.children)
    own = np.array([x.own for x in nodes], float)
    whole = max(1.0, total[0])
    return np.column_stack(
        [
            np.log1p(total), np.log1p(own), link / np.maximum(total, 1), np.log1p(tags), np.log1p(total / tags), np.minimum([x.depth for x in nodes], 20), sibling / siblings, np.minimum(siblings, 50),
            paragraphs / tags, marks / np.maximum(total, 1) * 100, total / whole, [x.first for x in nodes], tag_score, low, high, above, np.log1p(total[parent]), (link / np.maximum(total, 1))[parent], (paragraphs / tags)[parent], tag_score[parent],
        ]
    )


#: What a split must gain, in log odds weighted by text.
SPLIT_COST = 20.0
#: Weight of a node that holds no text itself, for its subtree as a whole.
VOTE = 2.0


def decode(nodes: list[Node], split_cost: float = SPLIT_COST) -> set[int]:
    """Which nodes' own text is kept (by id).

    Each node's own text weighs by its length. A subtree is kept whole, dropped whole, or mixed: then each child, and
    the node's own text, has what is best for it. Where these parts disagree, some kept whole and some dropped whole,
    ``split_cost`` is paid, once for the node at which they part.
    """
    keep: dict[int, float] = {}
    best: dict[int, float] = {}
    mixed: dict[int, bool] = {}
    for x in reversed(nodes):
        own = x.logit * (1.0 + np.sqrt(x.own) if x.own else VOTE)
        whole, split = own, abs(own) if x.own else 0.0
        sides = {own > 0} if x.own else set()
        for c in x.children:
            whole += keep[id(c)]
            split += best[id(c)]
            if not mixed[id(c)]:
                sides.add(keep[id(c)] > 0)
        if len(sides) > 1:
            split -= split_cost
        keep[id(x)] = whole
        mixed[id(x)] = bool(x.children) and split > abs(whole)
        best[id(x)] = split if mixed[id(x)] else abs(whole)
    kept: set[int] = set()
    open_nodes: list[tuple[Node, bool | None]] = [(nodes[0], None)]
    while open_nodes:
        x, decided = open_nodes.pop()
        if decided is None and not mixed[id(x)]:
            decided = keep[id(x)] > 0
        if decided or decided is None and x.logit > 0:
            kept.add(id(x))
        open_nodes += ((c, decided) for c in x.children)
    return kept


def texts_of(sources: list[str | None], model: Model) -> list[str]:
    """Main texts; null and empty pages, and pages without any text kept, give empty ones."""
    parsed = [parse(s) if s else None for s in sources]
    full = [p[0] for p in parsed if p]
    if full:
        logits = model.predict(np.vstack([node_features(nodes, model) for nodes in full]))
        at = 0
        for nodes in full:
            for node in nodes:
                node.logit = float(logits[at])
                at += 1
    out = []
    for p in parsed:
        if not p:
            out.append("")
            continue
        kept = decode(p[0])
        # A piece that is only a boundary counts as space whoever holds it.
        out.append(" ".join("".join(t if id(node) in kept or t == " " else " " for node, t in p[1]).split()))
    return out


_SYLLABLES = "ba re ti on en st er la mo du ne qua vi sol ter an pe lo mi gra".split()
# Words that site builders give to parts of pages, by what the parts hold.
MAIN_NAMES = "content article post entry story body main text page-content article-body post-content entry-content".split()
BAD_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb topnav".split(), "header": "header masthead banner site-header top".split(), "footer": "footer site-footer copyright bottom legal".split(),
    "aside": "sidebar aside widget related rail recommended".split(), "notice": "cookie notice consent gdpr alert popup subscribe newsletter".split(), "ad": "ad ads advert advertisement sponsor promo sponsored banner-ad".split(),
    "comments": "comments comment reply discussion disqus responses".split(), "form": "form search login signup contact".split(), "share": "share social tags byline meta author".split(),
}


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    if len(words) > 6 and r.random() < 0.7:
        words[r.randint(2, len(words) - 2)] += ","
    mark = r.choice(["", "%%%", "!!", "&amp;", "***"]) if r.random() < 0.1 else ""
    return " ".join(w + mark for w in words).capitalize() + r.choice(".....?!")


def _prose(r: random.Random, low: int, high: int) -> str:
    if r.random() < 0.15:
        return _sentence(r, 1, 3)
    return " ".join(_sentence(r, 1 if r.random() < 0.3 else 5, 18) for _ in range(r.randint(low, high)))


def _bad_part(r: random.Random, kind: str) -> str:
    name = r.choice(BAD_NAMES[kind])
    attrs = r.choice(["", f' class="{name}"', f' id="{name}"', f' class="{name} box" role="x"'])
    links = "".join(f'<li><a href="/{i}">{_sentence(r, 1, 3)}</a></li>' for i in range(r.randint(3, 9)))
    if kind == "nav":
        return r.choice([f"<nav{attrs}><ul>{links}</ul></nav>", f'<div class="{name}"><ul>{links}</ul></div>', f"<nav><a href=/>{_sentence(r, 1, 2)}</a> <a href=/b>{_sentence(r, 1, 2)}</a></nav>"])
    if kind == "header":
        inner = r.choice([f"<h1>{_sentence(r, 1, 4)}</h1>", f"<p>{_sentence(r, 2, 8)}</p>", f'<a href="/">{_sentence(r, 1, 3)}</a><ul>{links}</ul>'])
        return r.choice([f"<header{attrs}>{inner}</header>", f'<div class="{name}">{inner}</div>'])
    if kind == "footer":
        inner = r.choice([f"&copy; {_sentence(r, 1, 3)} &middot; {_sentence(r, 3, 9)}", f"<p>{_prose(r, 1, 2)}</p>", f"<ul>{links}</ul><p>&copy; {_sentence(r, 2, 6)}</p>"])
        return r.choice([f"<footer{attrs}>{inner}</footer>", f"<footer>{inner}</footer>", f'<div id="{name}">{inner}</div>'])
    if kind == "aside":
        inner = r.choice([f"<h3>{_sentence(r, 1, 4)}</h3><ul>{links}</ul>", f"<p>{_prose(r, 1, 3)}</p>", f"<div><a href=x>{_sentence(r, 3, 8)}</a></div>" * r.randint(1, 4)])
        return r.choice([f"<aside{attrs}>{inner}</aside>", f'<div class="{name}">{inner}</div>', f'<section class="{name}">{inner}</section>'])
    if kind == "comments":
        each = "".join(f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><p>{_prose(r, 1, 4)}</p></div>' if r.random() < 0.7 else f'<li class="comment">{_prose(r, 1, 3)}</li>' for _ in range(r.randint(1, 6)))
        return r.choice([f'<section id="comments"><h2>{_sentence(r, 1, 2)}</h2>{each}</section>', f'<div class="{name}">{each}</div>', f'<ol class="comment-list comments">{each}</ol>'])
    if kind == "form":
        return f'<form{attrs}><label>{_sentence(r, 1, 3)}</label><input name=q><p>{_sentence(r, 2, 9)}</p><button>{_sentence(r, 1, 2)}</button></form>'
    if kind == "share":
        return f'<div class="{name}">{r.choice([_sentence(r, 1, 4), f"<ul>{links}</ul>", f"<a href=x>{_sentence(r, 1, 2)}</a>"])}</div>'
    inner = r.choice([_prose(r, 1, 2), f"<p>{_prose(r, 1, 3)}</p>", f"<a href=x>{_sentence(r, 2, 8)}</a>"])
    return f'<{(t := r.choice(["div", "div", "section", "p" if not inner.startswith("<p") else "div"]))} class="{name}">{inner}</{t}>'


def _good_blocks(r: random.Random) -> list[str]:
    if r.random() < 0.12:  # a stub of an article
        title = _sentence(r, 1, 5)
        return [f"<h1>{title}</h1>", r.choice(["<p>{}</p>", "<p><b>{}<br>"]).format(title)]
    out = [f"<h1>{_sentence(r, 2, 12)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 1, 2, 2, 4, 8, 15, 30])):
        kind = r.random()
        if kind < 0.62:
            out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>"]).format(_prose(r, 1, 7)))
        elif kind < 0.7:
            out.append(f"<h2>{_sentence(r, 1, 8)}</h2>")
        elif kind < 0.77:
            out.append("<ul>" + "".join(f"<li>{_sentence(r, 2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.82:
            out.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(_prose(r, 1, 3))}</blockquote>")
        elif kind < 0.86:
            out.append("<table>" + "".join(f"<tr><td>{_sentence(r, 1, 4)}</td><td>{_sentence(r, 1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
        elif kind < 0.9:
            out.append(f"<pre>{_prose(r, 1, 3)}</pre>")
        elif kind < 0.95:
            out.append(f"<p>{_sentence(r, 4, 9)} <a href=y>{_sentence(r, 1, 4)}</a> {_sentence(r, 4, 9)}</p>")
        else:
            out.append(f"<div>{_prose(r, 1, 4)}</div>")
    return out


def training_pages(count: int = 1500, seed: int = 7) -> list[str]:
    """Pages whose main text lies between the characters U+E000 and U+E001, in pieces."""
    r = random.Random(seed)
    pages = []
    for _ in range(count):
        blocks = [re.sub(r">([^<]+)", lambda m: ">\ue000" + m[1] + "\ue001", b) for b in _good_blocks(r)]
        for kind in ("ad", "share", "aside", "form"):
            if r.random() < 0.12:
                blocks.insert(r.randint(0, len(blocks)), _bad_part(r, kind))
        inner = "".join(blocks)
        name = r.choice(MAIN_NAMES)
        shell = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", f'<div class="{name}">{{}}</div>', f'<div id="{name}">{{}}</div>', f'<main><article class="{name}">{{}}</article></main>', f"<section class={name}>{{}}</section>", "<div>{}</div>", "{}", "<table><tr><td>{}</td></tr></table>"])
        before = [_bad_part(r, k) for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.45]
        after = [_bad_part(r, k) for k in ("share", "ad", "comments", "aside", "nav", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        body = "".join(before) + shell.format(inner.replace("{", "(").replace("}", ")")) + "".join(after)
        if r.random() < 0.35:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout"])}">{body}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>")
    return pages


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, model: Model, trees: int = 60, rate: float = 0.25, bins: int = 32) -> None:
    """Second-order boosting of logistic loss over histograms of the features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    share = float(np.average(y, weights=weight))
    model.base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), model.base)
    inner = (1 << model.depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = weight * (p - y), weight * p * (1 - p)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(model.depth):
            width, base = 1 << level, (1 << level) - 1
            gains = np.zeros((x.shape[1], width))
            cuts = np.zeros((x.shape[1], width), np.int64)
            for j in range(x.shape[1]):
                key = (at - base) * bins + binned[:, j]
                g = np.cumsum(np.bincount(key, gradient, width * bins).reshape(width, bins), 1)
                h = np.cumsum(np.bincount(key, curve, width * bins).reshape(width, bins), 1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[:, len(edges[j]) :] = 0
                cuts[j] = gain.argmax(1)
                gains[j] = gain.max(1)
            choice = gains.argmax(0)
            for k in range(width):
                j = choice[k]
                if gains[j, k] > 1e-6:
                    feature[base + k], bound[base + k] = j, edges[j][cuts[j, k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > bound[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curve, inner + 1) + 1)
        model.features.append(feature)
        model.bounds.append(bound)
        model.values.append(value)
        margin += value[leaf]


@cache
def trained() -> Model:
    """The model for this code's own training pages; always the same."""
    pages, model = [], Model()
    for source in training_pages():
        nodes, pieces = parse(source)
        good: dict[int, int] = {}
        inside = False
        for node, piece in pieces:
            for part in re.split("([\ue000\ue001])", piece):
                inside = part == "\ue000" if part in "\ue000\ue001" and part else inside
                if inside and part != "\ue000":
                    good[id(node)] = good.get(id(node), 0) + len(part) - part.count(" ")
        marked = [good.get(id(x), 0) for x in nodes]
        whole = [x.own for x in nodes]
        index = {id(x): i for i, x in enumerate(nodes)}
        for i in range(len(nodes) - 1, 0, -1):
            p = index[id(nodes[i].parent)]
            marked[p] += marked[i]
            whole[p] += whole[i]
        pages.append((nodes, np.array([m / max(1, w) for m, w in zip(marked, whole, strict=True)]), np.array(whole)))
    sums: dict[tuple[bool, str], list[float]] = {}
    for nodes, label, whole in pages:
        for node, y, n in zip(nodes, label, whole, strict=True):
            if n:
                for key in {(False, node.tag), *((True, t) for t in attribute_tokens(node))}:
                    s = sums.setdefault(key, [0.0, 0.0])
                    s[0] += 2 * y - 1
                    s[1] += 1
    for (token, name), (s, n) in sums.items():
        (model.tokens if token else model.tags)[name] = s / (n + 5)
    x = np.vstack([node_features(nodes, model) for nodes, _, _ in pages])
    y, n = np.concatenate([p[1] for p in pages]), np.concatenate([p[2] for p in pages])
    use = n > 0
    boost(x[use], y[use], np.minimum(1 + np.log1p(n[use]) / 4, 3), model)
    return model


#: Pages handled together, and their characters at most unless one has more, so that memory doesn't follow Arrow batches.
PAGES, PAGE_CHARS = 64, 4 << 20


def _groups(sources: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, source in enumerate(sources):
        if i > first and (i - first == PAGES or size + len(source or "") > PAGE_CHARS):
            yield first, i
            first, size = i, 0
        size += len(source or "")
    if sources:
        yield first, len(sources)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html gives an empty text, and so does a page none of whose nodes counts as main text. Character
    references are decoded, white space in a block becomes one space, and blocks are joined in page order by one space.
    Each row is judged by itself: rows that share a page_id, or are null there, stay apart, and repeated pages give
    repeated rows. A page of any length is read whole, in time linear in its length. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for low, high in _groups(sources):
                part = batch.slice(low, high - low)
                texts = texts_of(sources[low:high], model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
