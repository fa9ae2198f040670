"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its elements; block elements and marked ones are the model's nodes, each content or not. Unmarked paragraphs and
headings of one parent are one node, and so are its unmarked list items, rows or cells, so that a long run of them is one witness. A node has a unary
potential (its tag, words of its class, id and role, lengths, link density) and one with its parent (a 2 x 2 table for each
kind of child). Sum-product messages go up from the leaves and down from the root, which gives every node's exact content marginal; the
text of nodes at one half or more is kept, in page order. The parameters are fitted by maximum likelihood (the gradient
comes from the same messages) to labelled pages that this module builds from layouts: nothing is learned from the pages to be read.
A page of which nothing reaches one half, but some text outside of menus and forms reads like prose, gives the most likely prose.

Defined results: null or empty html gives empty text; html without any tag is its own text; scripts, styles, comments and the head never
count; unclosed, stray and unknown tags are tolerated; repeated rows give equal texts; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Nothing inside is text of the page; other inline elements (math, button, media) are part of the text around them.
_SKIPPED = frozenset("script style noscript template head title svg iframe textarea select".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: start tag -> open tags that it ends, and the tags that shield them
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Unmarked siblings of these tags share a node.
_SHARED = {t: "p" for t in "p h1 h2 h3 h4 h5 h6 pre blockquote".split()} | {t: t for t in "li dt dd tr td th tbody".split()}
KINDS = {"text": "p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption td th", "list": "ul ol li dl tr tbody table", "part": "article main section div body figure", "frame": "nav aside footer header form menu fieldset dialog"}
_KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags.split()}


@dataclass
class Page:
    """Nodes in page order, a parent before its children; texts as (node or -1 for a break, text)."""

    tags: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    labels: list[str | None] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    texts: list[tuple[int, str, bool]] = field(default_factory=list)
    shared: dict[tuple[int, str], int] = field(default_factory=dict)

    def block(self, tag: str, mark: str, parent: int, label: str | None) -> int:
        """The node of a block element: its own, or one with its unmarked siblings."""
        common = None if mark else _SHARED.get(tag)
        if common is None:
            return self.add(tag, mark, parent, label)
        node = self.shared.get((parent, common))
        if node is None:
            node = self.shared[parent, common] = self.add(common, mark, parent, label)
        return node

    def add(self, tag: str, mark: str, parent: int, label: str | None = None) -> int:
        self.tags.append(tag)
        self.marks.append(mark)
        self.labels.append(label)
        self.parents.append(parent)
        return len(self.tags) - 1


def _marks(attributes: str) -> tuple[str, str | None]:
    """Words of class, id, role and the like, and a label if the page is a training page."""
    words, label = [], None
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words.append(value)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            words.append("invisible")
        elif name == "data-label":
            label = value
    return " ".join(words), label


class _Open:
    """The open elements. For each tag the places where it stands on the stack are known, so that no end tag searches a deep stack."""

    def __init__(self, root: int, texts: list[tuple[int, str, bool]]):
        self.stack: list[tuple[str, int]] = [("", root)]  # tag, and the node that its text belongs to
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]
        self.texts = texts

    @property
    def node(self) -> int:
        return self.stack[-1][1]

    @property
    def in_link(self) -> bool:
        return bool(self.at["a"])

    def push(self, tag: str, node: int) -> None:
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, node))

    def close(self, to: int) -> None:
        """Down to that many open elements."""
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
                self.texts.append((-1, " ", False))

    def end(self, tag: str) -> None:
        """An end tag: an inline element ends only within its block."""
        places = self.at.get(tag)
        if places and (tag in _BLOCK or places[-1] > self.blocks[-1]):
            self.close(places[-1])

    def end_paragraph(self) -> None:
        if self.stack[self.blocks[-1]][0] == "p":
            self.close(self.blocks[-1])

    def end_items(self, ended: set[str], shields: set[str]) -> None:
        """The outermost open one of `ended` inside the innermost of `shields`, and all in it."""
        shield = max((self.at[t][-1] for t in shields if self.at.get(t)), default=0)
        found = [places[k] for t in ended if (places := self.at.get(t)) and (k := bisect_right(places, shield)) < len(places)]
        if found:
            self.close(min(found))


def parse(html: str) -> Page:
    page = Page()
    root = page.add("", "", -1)
    texts = page.texts
    elements = _Open(root, texts)
    skipping: str | None = None
    depth = at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at and skipping is None:
            texts.append((elements.node, unescape(html[at:end]), elements.in_link))
        if m is None:
            break
        at = m.end()
        closing, tag = (m[1] or m[4]), (m[2] or m[5])
        if tag is None:
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if skipping is not None:
            # An unclosed element doesn't swallow the page: a head ends at the first block, others where a block around them ends.
            over = tag in _BLOCK and (not closing if skipping == "head" else closing and bool(elements.at.get(tag)))
            if tag == skipping:
                depth += -1 if closing else 0 if tag in _RAW else 1
            if not over:
                skipping = skipping if depth else None
                continue
            skipping = None
        if closing:
            elements.end(tag)
            continue
        if tag in _SKIPPED:
            if tag in _RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            elif not attributes.endswith("/"):
                skipping, depth = tag, 1
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                texts.append((-1, " ", False))
            continue
        if tag in _CLOSES_P:
            elements.end_paragraph()
        if tag in _ENDS:
            elements.end_items(*_ENDS[tag])
        mark, label = _marks(attributes) if attributes else ("", None)
        node = elements.node
        if tag in _BLOCK:
            texts.append((-1, " ", False))
            node = page.block(tag, mark, node, label)
        elif mark:
            node = page.add(tag, mark, node, label)
        if not attributes.endswith("/") or tag in _BLOCK:
            elements.push(tag, node)
    return page


@lru_cache(maxsize=4096)
def _mark_words(mark: str) -> tuple[str, ...]:
    words = {w.lower() for w in _WORD.findall(mark)}
    return tuple(sorted({f"m:{w[:6]}" for w in words if len(w) > 1}))


def _bucket(n: int) -> int:
    return 0 if n == 0 else 1 if n < 25 else 2 if n < 100 else 3 if n < 400 else 4


def _entitle(page: Page, title: list[str], node: int, text: str) -> None:
    """A short text gives its first word to those elements that begin with it; what begins with a long one has no title."""
    words = _WORD.findall(text) if len(text) < 40 else []
    name = f"w:{words[-1 if words[0].isdigit() else 0].lower()[:8]}" if words else "w:"
    while node >= 0 and not title[node]:
        title[node] = name
        node = page.parents[node]


def node_features(page: Page) -> list[tuple[str, ...]]:
    n = len(page.tags)
    own, linked, stops, title = [0] * n, [0] * n, [0] * n, [""] * n
    for node, text, link in page.texts:
        if node >= 0:
            size = len(text.strip())
            if size:
                _entitle(page, title, node, text)
            own[node] += size
            if link:
                linked[node] += size
            elif "." in text or "," in text:
                stops[node] += 1
    below, below_linked = own[:], linked[:]
    for k in range(n - 1, 0, -1):
        below[page.parents[k]] += below[k]
        below_linked[page.parents[k]] += below_linked[k]
    total = below[0] or 1
    core = any(t in ("article", "main") for t in page.tags)
    out, depth = [], [0] * n
    for k in range(n):
        parent = page.parents[k]
        depth[k] = depth[parent] + 1 if parent >= 0 else 0
        dense = 0 if below[k] == 0 else 1 + int(3 * below_linked[k] / (below[k] + 1))
        share = int(4 * below[k] / (total + 1))
        out.append((f"t:{page.tags[k]}", f"o:{_bucket(own[k])}{min(stops[k], 2)}", f"l:{dense}", f"s:{share}{_bucket(below[k])}", "bias", f"u:{page.tags[parent] if parent >= 0 else None}{page.tags[k]}", f"c:{core}{_KIND.get(page.tags[k])}", title[k] or "w:", *_mark_words(page.marks[k])))
    return out


@dataclass
class TreeModel:
    unary: dict[str, float] = field(default_factory=dict)
    pair: dict[str, list[float]] = field(default_factory=lambda: {k: [0.5, -0.5, -0.5, 0.5] for k in (*KINDS, "other")})
    _steps: dict = field(default_factory=dict, repr=False)  # sums of squared slopes: each parameter has its own rate

    def messages(self, page: Page, features: list[tuple[str, ...]]) -> tuple[list[float], list[float], list[float], list[list[float]]]:
        """Sum-product: log-odds of each node from below, the message to its parent, its full log-odds, and its pair table."""
        n, get = len(page.tags), self.unary.get
        below = [sum(get(f, 0.0) for f in fs) for fs in features]
        tables = [self.pair[_KIND.get(t, "other")] for t in page.tags]
        up, full = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):  # upwards: parents come before children, so their messages are complete
            b, (t00, t01, t10, t11) = below[k], tables[k]
            up[k] = _log_sum(t10, t11 + b) - _log_sum(t00, t01 + b)
            below[page.parents[k]] += up[k]
        full[0] = below[0]
        for k in range(1, n):  # downwards
            rest, (t00, t01, t10, t11) = full[page.parents[k]] - up[k], tables[k]
            full[k] = below[k] + _log_sum(t01, t11 + rest) - _log_sum(t00, t10 + rest)
        return below, up, full, tables

    def _moved(self, name, value: float, slope: float, rate: float) -> float:
        sums = self._steps[name] = self._steps.get(name, 1e-2) + slope * slope
        return value + rate * (slope - 1e-3 * value) / math.sqrt(sums)

    def step(self, page: Page, features: list[tuple[str, ...]], labels: list[int], rate: float) -> None:
        """One gradient step on the page's log-likelihood: what the labels show less what the marginals expect."""
        below, up, full, tables = self.messages(page, features)
        slopes: dict = {}
        for k, fs in enumerate(features):
            miss = labels[k] - _probability(full[k])
            for f in fs:
                slopes[f] = slopes.get(f, 0.0) + miss
            if k:
                p, t = page.parents[k], tables[k]
                rest = full[p] - up[k]
                joint = [t[0], t[1] + below[k], t[2] + rest, t[3] + rest + below[k]]
                top = max(joint)
                joint = [math.exp(j - top) for j in joint]
                z, kind = sum(joint), _KIND.get(page.tags[k], "other")
                for j in range(4):
                    slopes[kind, j] = slopes.get((kind, j), 0.0) + (j == 2 * labels[p] + labels[k]) - joint[j] / z
        for name, slope in slopes.items():
            if isinstance(name, tuple):
                table = self.pair[name[0]]
                table[name[1]] = self._moved(name, table[name[1]], slope, rate)
            else:
                self.unary[name] = self._moved(name, self.unary.get(name, 0.0), slope, rate)


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def _probability(odds: float) -> float:
    return 1 / (1 + math.exp(-odds)) if odds >= 0 else 1 - 1 / (1 + math.exp(odds))


class _Layouts:
    """Labelled pages: pseudo-words in many layouts; every element says whether its text is content."""

    CONTENT = "content post post-content entry-content article-body main-content story article-text body-text page-content entry post-body markdown-body".split()
    MENU = "menu navbar nav navigation breadcrumb breadcrumbs topbar main-menu site-nav toc pagination pager skip-link".split()
    SIDE = "sidebar side widget related related-posts rail secondary more-stories recommended popular trending side-bar".split()
    AD = "ad ads advert advertisement banner-ad sponsored promo ad-slot adsense sponsor ad-container advertorial".split()
    NOTICE = "cookie cookie-notice notice consent alert gdpr-banner message popup modal cookie-banner disclaimer paywall warning announcement".split()
    FORM = "newsletter signup subscribe search search-form login contact-form".split()
    TALK = "comments comment comment-list reader-comments discussion responses disqus replies user-comments".split()
    META = "share social share-buttons tags byline author meta post-meta tools social-links rating".split()
    FOOT = "footer site-footer copyright legal bottom colophon foot credits".split()
    HEAD = "header site-header masthead logo branding top-bar page-header".split()
    TALK_TITLES = ["Comments", "Comment", "Discussion", "Responses", "Replies", "Leave a reply", "Join the conversation", "Kommentare", "Commentaires", "Comentarios", "Reacties", "Commenti"]

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = ["".join(self.r.choice("the and ing er on st re an le en".split()) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        return " ".join(w + self.r.choice(["", "", "", "", ",", "."]) for w in out).capitalize() + self.r.choice([".", ".", ""])

    def el(self, tag: str, label: int, inside: str, names: list[str] | None = None) -> str:
        mark = ""
        if names:
            mark = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'
        return f'<{tag}{mark} data-label="{label}">{inside}' + ("" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>")

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>'

    def prose(self, label: int, low: int = 1, high: int = 6) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            kind = self.r.random()
            text = self.words(1, 8) if self.r.random() < 0.25 else self.words(15, 90)
            if self.r.random() < 0.3:
                text += f" <b>{self.words(1, 5)}</b> {self.words(2, 20)}"
            if self.r.random() < 0.2:
                text += f" {self.link()} {self.words(2, 9)}"
            elif label and self.r.random() < 0.08:  # a paragraph full of links
                text = " ".join(f"{self.words(1, 6)} {self.link()}" for _ in range(self.r.randint(2, 5))) + f" {self.words(1, 8)}"
            if kind < 0.72:
                out.append(self.el("p", label, text))
            elif kind < 0.79:
                out.append(self.el(self.r.choice(("h2", "h3", "h4")), label, self.words(2, 7)))
            elif kind < 0.86:
                items = "".join(self.el("li", label, self.words(2, 14)) for _ in range(self.r.randint(2, 5)))
                out.append(self.el(self.r.choice(("ul", "ol")), label, items))
            elif kind < 0.9:
                out.append(self.el("blockquote", label, self.el("p", label, text) if self.r.random() < 0.5 else text))
            elif kind < 0.93:
                out.append(self.el("pre", label, text))
            elif kind < 0.96:
                rows = "".join(self.el("tr", label, "".join(self.el("td", label, self.words(1, 5)) for _ in range(3))) for _ in range(3))
                out.append(self.el("table", label, rows))
            else:
                out.append(self.el("div", label, self.el("p", label, text)))
        return "".join(out)

    def menu(self) -> str:
        items = "".join(self.el("li", 0, self.link()) for _ in range(self.r.randint(3, 9)))
        inner = self.el("ul", 0, items) if self.r.random() < 0.7 else " ".join(self.link() for _ in range(self.r.randint(2, 7)))
        return self.el("nav", 0, inner, self.r.choice((None, self.MENU))) if self.r.random() < 0.6 else self.el("div", 0, inner, self.MENU)

    def aside(self) -> str:
        inner = self.el("h3", 0, self.words(1, 3)) + (self.el("ul", 0, "".join(self.el("li", 0, self.link()) for _ in range(4))) if self.r.random() < 0.6 else self.prose(0, 1, 2))
        return self.el("aside", 0, inner, self.r.choice((None, self.SIDE))) if self.r.random() < 0.5 else self.el(self.r.choice(("div", "section")), 0, inner, self.SIDE)

    def small(self, names: list[str], tags: tuple[str, ...] = ("div", "div", "section", "p", "span")) -> str:
        tag = self.r.choice(tags)
        inner = self.words(3, 40) if tag in ("p", "span") or self.r.random() < 0.5 else self.prose(0, 1, 2)
        return self.el(tag, 0, inner + (self.link() if self.r.random() < 0.4 else ""), names)

    def form(self) -> str:
        inner = f'{self.words(2, 12)} <label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>'
        inner = self.el("p", 0, self.words(3, 20)) + inner if self.r.random() < 0.5 else inner
        return self.el("form", 0, inner, self.r.choice((None, self.FORM)))

    def talk(self) -> str:
        posts = "".join(
            self.el(self.r.choice(("div", "li", "article")), 0, self.el("p", 0, self.words(1, 3)) + self.prose(0, 1, 2), self.TALK) for _ in range(self.r.randint(1, 4))
        )
        title = self.el(self.r.choice(("h2", "h3", "h4")), 0, (f"{self.r.randint(1, 99)} " if self.r.random() < 0.3 else "") + self.r.choice(self.TALK_TITLES))
        if self.r.random() < 0.25:  # nothing but the title tells what it is
            plain = self.el("ul", 0, "".join(self.el("li", 0, self.words(1, 20)) for _ in range(self.r.randint(1, 4)))) if self.r.random() < 0.5 else self.prose(0, 1, 3)
            return self.el(self.r.choice(("section", "div")), 0, title + plain)
        return self.el(self.r.choice(("section", "div", "ol")), 0, (title if self.r.random() < 0.6 else self.el("h3", 0, self.words(1, 2))) + posts, self.TALK)

    def extra(self) -> str:
        return self.r.choice((self.form, lambda: self.small(self.AD), lambda: self.small(self.NOTICE), self.aside, lambda: self.small(self.META)))()

    def page(self) -> str:
        r = self.r
        title = self.words(2, 8)
        body = self.el("h1", 1, title) if r.random() < 0.8 else ""
        if body and r.random() < 0.25:
            body = self.el("header", 1, body)
        parts = [self.prose(1, 1, 4) for _ in range(r.randint(1, 4))]
        if r.random() < 0.3:  # chapters of many short or tiny paragraphs
            high = r.choice((2, 5, 12))
            parts.append("".join(self.el("p", 1, self.words(1, high)) for _ in range(r.randint(8, 60))))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 4))):
            parts.insert(r.randint(0, len(parts)), self.extra())
        if r.random() < 0.3:  # chapters with elements of their own
            tag = r.choice(("section", "div"))
            parts = [self.el(tag, 1, part) for part in parts] if r.random() < 0.5 else [self.el(tag, 1, "".join(parts), r.choice((None, None, self.CONTENT)))]
        body += "".join(parts)
        if r.random() < 0.15:
            body += self.talk()
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        names = self.CONTENT if r.random() < (0.75 if tag in ("div", "section") else 0.3) else None
        core = self.el(tag, 1, body, names)
        if tag == "article" and r.random() < 0.3:
            core = self.el("main", 1, core + (self.talk() if r.random() < 0.3 else ""))
        if r.random() < 0.15:
            core = body  # paragraphs straight in the page
        before = [f() for f in (lambda: self.el("header", 0, self.el(r.choice(("h1", "h1", "p", "div")), 0, self.words(1, 6)) + (self.menu() if r.random() < 0.5 else ""), r.choice((None, self.HEAD))), self.menu, lambda: self.small(self.AD), lambda: self.small(self.NOTICE), self.aside, self.form) if r.random() < 0.4]
        after = [f() for f in (self.aside, self.talk, lambda: self.small(self.AD), self.form, lambda: self.small(self.NOTICE), self.menu) if r.random() < 0.35]
        foot = self.el("footer", 0, f"&copy; {self.words(2, 15)}", r.choice((None, self.FOOT))) if r.random() < 0.6 else self.small(self.FOOT, ("div",))
        r.shuffle(before)
        r.shuffle(after)
        middle = "".join([*before, core, *after])
        if r.random() < 0.4:
            middle = self.el("div", 0, middle, ["page", "wrapper", "container", "site", "row", "layout", "main-wrap", "app"])
        return f"<html><head><title>{title}</title></head><body>{middle}{foot}</body></html>"


@lru_cache(maxsize=1)
def trained_model(pages: int = 1500, passes: int = 6, seed: int = 5) -> TreeModel:
    layouts, model = _Layouts(seed), TreeModel()
    examples = []
    for _ in range(pages):
        page = parse(layouts.page())
        labels = [int(x or 0) for x in page.labels]
        examples.append((page, node_features(page), labels))
    order = random.Random(seed)
    for k in range(passes):
        order.shuffle(examples)
        for e in examples:
            model.step(*e, rate=0.3)
    model._steps.clear()
    return model


def content_marginals(page: Page, model: TreeModel) -> list[float]:
    return [_probability(x) for x in model.messages(page, node_features(page))[2]]


#: The least marginal of a node that is taken for want of a better one, and of those beside it as a part of the best one's.
FAINT, BESIDE = 0.001, 0.5


def _likely_prose(page: Page, marginals: list[float]) -> list[bool]:
    """For a page without a likely node: its most likely prose (sentences outside of frames), and what is about as likely. None if no node has prose."""
    n = len(page.tags)
    framed, prose = [False] * n, [False] * n
    for k in range(n):
        parent = page.parents[k]
        framed[k] = _KIND.get(page.tags[k]) == "frame" or (parent >= 0 and framed[parent])
    for node, text, link in page.texts:
        if node >= 0 and not link and not framed[node] and len(text.strip()) >= 25 and re.search(r"[.!?,;:]", text):
            prose[node] = True
    best = max((marginals[k] for k in range(n) if prose[k]), default=0.0)
    return [best >= FAINT and not framed[k] and marginals[k] >= BESIDE * best for k in range(n)]


def main_text(html: str, model: TreeModel | None = None) -> str:
    page = parse(html)
    if len(page.tags) == 1 and not _TAG.search(html):
        keep = [True]
    else:
        marginals = content_marginals(page, model or trained_model())
        keep = [p >= 0.5 for p in marginals]
        if not any(keep[n] for n, t, _ in page.texts if n >= 0 and t.strip()):
            keep = _likely_prose(page, marginals)
    return " ".join("".join(t if n < 0 or keep[n] else " " * (not t.strip()) for n, t, _ in page.texts).split())


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text."""
    shared = pages.sparkSession.sparkContext.broadcast(trained_model())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py().decode("utf-8", "replace"), shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), as_bytes("html").alias("html"))
    return slim.mapInArrow(read, "page_id long, url string, text string")
