"""Main text of pages by a tree-structured graphical model over the document's elements.

A page is read into a tree of its block elements; inline markup stays inside its block. Every element is content or not: its
tag, its class and id words and the text below it give a potential of its own, and each parent and child share one. Upward
and downward sum-product messages give every element's marginal, for many trees at once, level by level. Weights are
trained by gradient ascent on labelled pages, with expectations from the same messages. Blocks of elements that are
content rather than not are the text.

Cases: null and empty html give an empty text, html without tags is one block; unclosed and stray tags are repaired as browsers do for
blocks, list items and cells; what is behind the last > is text; controls, players and drawings that are never closed hide nothing, closed
ones hide what they hold, and end with the element around them; rows that repeat a page_id get a row each; an empty table gives no
rows; other columns stay as they are, but for a column `text`, whose place the text takes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.mainpages import labelled_pages

#: Labelled pages to train on, steps, pages whose trees are decoded together.
PAGES, STEPS, BATCH = 600, 200, 256
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+|[^>]*+)>|<[!?][^>]+>""", re.DOTALL)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
# HTML's element names by how they behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark q s samp small span strike strong sub sup time tt u var output ruby rb rt rp nobr blink picture slot math mi mn mo mrow ms mtext msup msub mfrac msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
MUTE = frozenset("template noscript select datalist button object svg canvas audio video".split())
PHRASES_ONLY = frozenset("select datalist".split())
SKIP = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
END = {name: re.compile(rf"</{name}[\s>]", re.IGNORECASE) for name in MUTE}
CLOSED_BY = {"p": None, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}
GROUPS = {name: k for k, names in enumerate(("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tr", "td th", "blockquote pre", "figure", "figcaption caption", "details summary", "#root html", "body", "head", "address", "dialog menu")) for name in names.split()}
OTHER = max(GROUPS.values()) + 1
PAGE_LEVEL = (GROUPS["#root"], GROUPS["body"])
CLUES = tuple(
    frozenset(x.split())
    for x in (
        "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc", "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsense", "footer bottom copyright legal disclaimer colophon", "header masthead logo top brand topbar",
        "sidebar related widget recommended recommendations more popular trending", "share social tags meta toolbar byline author", "cookie cookies consent notice popup modal newsletter subscribe alert gdpr overlay signup", "comment comments reply replies response responses discussion disqus respond",
        "search login form contact", "article post story entry", "content body text main", "page wrapper container row layout site",
    )
)
N_NUMBERS = 12
N_FEATURES = OTHER + 1 + len(CLUES) + N_NUMBERS


@dataclass
class Page:
    """The block elements in page order, and the text blocks with their elements."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    group: list[int] = field(default_factory=lambda: [GROUPS["#root"]])
    clues: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


def read(source: str | None) -> Page:
    page, source = Page(), source or ""
    stack, names, pieces = [0], ["#root"], []
    opened: Counter[str] = Counter()  # how often each name is among the open ones, so that an end tag costs a look-up
    muted: list[str] = []  # the element that hides its text and what is open inside it
    hidden: Counter[str] = Counter()  # the same for these
    last_end: dict[str, int] = {}
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append((stack[-1], text, linked))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not muted:
            pieces.append(html.unescape(raw) if "&" in raw else raw)
            if links:
                linked += len(raw)

    def hide(name: str) -> None:
        muted.append(name)
        hidden[name] += 1

    def show() -> None:
        muted.clear()
        hidden.clear()

    def ends_later(name: str) -> bool:
        if name not in last_end:
            last_end[name] = max((m.start() for m in END[name].finditer(source)), default=-1)
        return last_end[name] >= at

    at, last = 0, source.rfind(">")
    while at <= last:
        m = TOKEN.search(source, at)
        if m is None:
            break
        say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if muted:
            if closing:
                if hidden[name]:
                    while (gone := muted.pop()) != name:
                        hidden[gone] -= 1
                    hidden[name] -= 1
                    continue
                if not opened[name] or name in INLINE:
                    continue
                show()  # the element around it ends
            elif name in RAW:
                end = SKIP[name].search(source, at)
                at = end.end() if end else len(source)
                continue
            elif muted[0] not in PHRASES_ONLY or name in INLINE or name in VOID or name in ("option", "optgroup", *MUTE):
                if name not in VOID and name not in INLINE and not m[3].endswith("/"):
                    hide(name)
                continue
            else:
                show()  # no list of options holds a block
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
        elif name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                pieces.append(" ")
        elif name in RAW:
            if not closing and not m[3].endswith("/"):
                end = SKIP[name].search(source, at)
                at = end.end() if end else len(source)
        elif name in MUTE:
            if not closing and not m[3].endswith("/") and (name in PHRASES_ONLY or ends_later(name)):
                hide(name)
        elif closing:
            if opened[name]:
                flush()
                while (gone := names.pop()) != name:
                    opened[gone] -= 1
                    stack.pop()
                opened[name] -= 1
                stack.pop()
                links = 0
        else:
            flush()
            # a block ends an open paragraph; items, rows and cells end their like
            while len(stack) > 1 and (names[-1] == "p" or names[-1] in (CLOSED_BY.get(name) or ()) and not (name in ("td", "th") and names[-1] == "tr")):
                opened[names.pop()] -= 1
                stack.pop()
            page.parent.append(stack[-1])
            page.depth.append(page.depth[stack[-1]] + 1)
            page.group.append(GROUPS.get(name, OTHER))
            clues = ()
            if m[3] and (found := NAMES.findall(m[3])):
                seen = {w for x in found for w in WORD.findall("".join(x).lower())}
                clues = tuple(k for k, c in enumerate(CLUES) if not c.isdisjoint(seen))
            page.clues.append(clues)
            stack.append(len(page.parent) - 1)
            names.append(name)
            opened[name] += 1
            links = 0
    show()
    if at < len(source):
        say(source[at:].partition("<!--")[0])
    flush()
    return page


class Forest:
    """The trees of some pages as arrays: parents, levels and features."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.first = np.cumsum([0, *sizes])
        shift = np.repeat(self.first[:-1], sizes)
        parent = np.array([x for p in pages for x in p.parent])
        self.parent = np.where(parent < 0, -1, parent + shift)
        depth = np.array([x for p in pages for x in p.depth])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        n = len(self.parent)
        f = np.zeros((n, N_FEATURES))
        f[np.arange(n), [x for p in pages for x in p.group]] = 1
        for i, clues in ((i + s, c) for p, s in zip(pages, self.first) for i, c in enumerate(p.clues) if c):
            f[i, [OTHER + 1 + k for k in clues]] = 1
        own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
        for s, p in zip(self.first, pages):
            for i, text, chars in p.blocks:
                own[s + i] += len(text)
                linked[s + i] += chars
                stops[s + i] += text.count(".") + text.count("?")
        below, below_linked = own.copy(), linked.copy()
        for level in reversed(self.levels[1:]):
            np.add.at(below, self.parent[level], below[level])
            np.add.at(below_linked, self.parent[level], below_linked[level])
        whole = np.repeat(np.maximum(below[self.first[:-1]], 1), sizes)
        top = np.isin(f[:, : OTHER + 1].argmax(1), PAGE_LEVEL)
        numbers = (np.ones(n), np.log1p(own) / 5, np.log1p(below) / 5, below_linked / (below + 1), linked / (own + 1), np.log1p(stops) / 3, own > 80, (own > 0) & (own < 25), below / whole, own / whole, below > 0.9 * whole, top & (own > 0))
        f[:, -N_NUMBERS:] = np.stack(numbers, 1)
        self.features = f
        # pairs with a child that carries text itself, and pairs right below the page, have tables of their own
        self.kind = (own > 0) + 2 * top[np.maximum(self.parent, 0)]


def logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


class TreeModel:
    def __init__(self):
        self.weights, self.pair = np.zeros(N_FEATURES), np.zeros((4, 2, 2))  # kind, parent, child

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element, and P(parent, child) of each element with its parent."""
        n = len(forest.parent)
        inner = np.zeros((n, 2))
        inner[:, 1] = forest.features @ self.weights
        up = np.zeros((n, 2))
        for level in reversed(forest.levels[1:]):
            up[level] = logsum(self.pair[forest.kind[level]] + inner[level][:, None, :])
            np.add.at(inner, forest.parent[level], up[level])
        down = np.zeros((n, 2))
        both = np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            p = forest.parent[level]
            rest = inner[p] + down[p] - up[level]
            joint = rest[:, :, None] + self.pair[forest.kind[level]] + inner[level][:, None, :]
            down[level] = logsum((rest[:, :, None] + self.pair[forest.kind[level]]).transpose(0, 2, 1))
            both[level] = np.exp(joint - logsum(joint.reshape(-1, 4))[:, None, None])
        belief = inner + down
        return np.exp(belief[:, 1] - logsum(belief)), both

    def train(self, pages: list[tuple[str, list[int]]], steps: int = STEPS, rate: float = 0.1) -> TreeModel:
        read_ = [read(p) for p, _ in pages]
        forest = Forest(read_)
        truth, weight = np.zeros(len(forest.parent)), np.zeros(len(forest.parent))
        for s, page, (_, labels) in zip(forest.first, read_, pages):
            for (i, text, _), y in zip(page.blocks, labels, strict=True):
                truth[s + i] += y * len(text)
                weight[s + i] += len(text)
        own = weight > 0
        labels = truth * 2 > weight
        for level in reversed(forest.levels[1:]):
            np.add.at(truth, forest.parent[level], truth[level])
            np.add.at(weight, forest.parent[level], weight[level])
        # an element without text of its own is what most of the text below it is
        y = np.where(own, labels, truth * 2 > weight).astype(int)
        child = np.flatnonzero(forest.parent >= 0)
        n = len(pages)
        moment = [0.0, 0.0, 0.0, 0.0]
        for step in range(1, steps + 1):
            p, both = self.marginals(forest)
            g = forest.features.T @ (y - p) / n - 0.01 * self.weights
            h = np.zeros_like(self.pair)
            np.add.at(h, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
            np.subtract.at(h, forest.kind[child], both[child])
            h = h / n - 0.01 * self.pair
            for k, (grad, value) in enumerate(((g, self.weights), (h, self.pair))):
                moment[2 * k] = 0.9 * moment[2 * k] + 0.1 * grad
                moment[2 * k + 1] = 0.99 * moment[2 * k + 1] + 0.01 * grad**2
                value += rate * (moment[2 * k] / (1 - 0.9**step)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
        return self

    def texts(self, sources: list[str | None]) -> list[str]:
        out = []
        for at in range(0, len(sources), BATCH):
            pages = [read(s) for s in sources[at : at + BATCH]]
            forest = Forest(pages)
            content = self.marginals(forest)[0] >= 0.5
            for s, page in zip(forest.first, pages):
                out.append("\n".join(text for i, text, _ in page.blocks if content[s + i]))
        return out


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """`pages` and the column text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or TreeModel().train(labelled_pages(PAGES)))
    return pages.withColumn("text", F.pandas_udf(lambda x: pd.Series(shared.value.texts(x.tolist()), dtype=str), "string")("html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
