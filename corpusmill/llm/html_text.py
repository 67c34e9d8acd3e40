"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features.

A page becomes a flat list of blocks, the stretches of text between block-level tags. Word count and link density of a
block and of its neighbours, its kind and level as a heading, the words of the dense run that it stands in, and what the names around it say
feed a small decision tree. Names are weak: of a class each word counts for what it is in it (`with-sidebar` is no sidebar), and a container that holds
the page's article, whatever its name, says nothing. The tree is trained here, on the labelled blocks of pages that labelled_blocks() writes, of
which some have no names and some have wrong ones.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.shared import need

# Elements that do not end a block, and those whose content is no text of the page.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle mpadded semantics mtable mtr mtd svg g path tspan".split())
_HIDDEN = frozenset("script style template iframe textarea select canvas audio video annotation metadata".split())
_RAW = frozenset("script style iframe textarea".split())  # of these, whatever follows is content up to the end tag
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTER = frozenset("nav aside footer form dialog menu button fieldset".split())
_INNER = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KINDS = {"p": 1, "li": 2, "dd": 2, "td": 3, "th": 3, "pre": 4, "blockquote": 4}
# Words of classes, ids and roles. Those of other things than the article; those of the article; those that say nothing beside another one; those
# that turn the article's words into others'; and those that say what a container has, not what it is.
_OTHER = frozenset("nav navbar navigation menu menus sidebar foot footer masthead topbar ad ads advert advertisement advertising sponsor sponsors sponsored promo promotion promotions banner cookie cookies consent notice notices notification alert modal popup overlay newsletter subscribe subscription signup login search share sharing social related recommend recommended recommendations comment comments commentlist reply replies disqus breadcrumb breadcrumbs pagination pager widget copyright legal contentinfo complementary disclaimer skiplink gdpr toolbar discussion feedback dialog".split())
_ARTICLE = frozenset("article post entry story".split())
_NEUTRAL = frozenset("content main body wrapper wrap inner outer container box block list items item area section region row group holder panel layout page".split())
_OF_OTHERS = frozenset("related recommended sponsored promo promoted ad advert latest more popular trending".split())
_HAS = frozenset("has with no without is js show hide".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _name(token: str) -> int:
    """What a class, id or role says: 1 the article, -1 something else, -2 a header, 0 nothing."""
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in _HAS:
        return 0
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    rest = list(words)
    while len(rest) > 1 and rest[-1] in _NEUTRAL:
        rest.pop()
    head = rest[-1]
    if head == "header":
        return 0 if _ARTICLE & set(rest) else -2
    if head in _ARTICLE:
        return -1 if _OF_OTHERS & set(rest[:-1]) else 1
    if (_OTHER & set(rest)) or (_OTHER & joined):
        return -1
    return 1 if len(words) == 1 and head in ("content", "main", "body") else 0


def _says(said: str) -> int:
    found = {_name(x) for x in said.split()}
    return -1 if -1 in found else -2 if -2 in found else 1 if 1 in found else 0


_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: int  # its level, or 0
    kind: int  # of the element it stands in, 0 for most
    inside: bool
    outside: bool


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page, in page order; of a page cut short, as far as it goes."""
    out: list[Block] = []
    held: list[str] = []
    linked, links = 0, 0
    stack: list[tuple[str, bool, int, int, int]] = []  # tag; and as they hold below it: inside, container of something else (-1: none), heading, kind
    state = (False, -1, 0, 0)
    around: list[int] = []  # of each such container the one around it
    words_in, inner_in, all_inner = [], [], 0  # words below each, and the articles and headings of the first level
    placed: list[int] = []  # the container of each block
    at, end = 0, len(html)
    unclosed: set[str] = set()  # hidden elements without a further end tag, whose start tags are ignored

    def put(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if links:
                linked += len(unescape(text).split())

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(held)).split()) if held else ""
        if text:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(linked, n), state[2], state[3], state[0], state[1] >= 0))
            placed.append(state[1])
            if state[1] >= 0:
                words_in[state[1]] += n
        held.clear()
        linked = 0

    while at < end:
        m = _TAG.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        name, attrs = (m[1], m[2]) if m[1] else (m[3], m[4])
        if not name:
            continue
        name, opens = name.lower(), m[0][1] != "/"
        if name == "a":
            links = max(0, links + (1 if opens else -1)) if opens is False or links == 0 else links
            continue
        if name in _HIDDEN and opens and not (attrs or "").rstrip().endswith("/"):
            close()
            over = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(html, at)
            if over:
                at = over.end()
            elif name in _RAW:
                at = end
            else:
                unclosed.add(name)
            continue
        if name in _INLINE:
            if name == "br":
                held.append(" ")
            continue
        close()
        links = 0
        if opens:
            if name in _VOID or (attrs or "").endswith("/"):
                continue
            said = _says(" ".join(a or b or c for a, b, c in _ATTR.findall(attrs))) if attrs else 0
            inside, container, heading, kind = state
            if name in _INNER or name == "h1":
                all_inner += 1
                if container >= 0:
                    inner_in[container] += 1
            if name in _OUTER or name in ("head", "title") or said == -1 and name not in ("body", "html") or (name == "header" or said == -2) and not inside:
                around.append(container)
                words_in.append(0)
                inner_in.append(0)
                container = len(around) - 1
            elif name in _INNER or said == 1:
                inside = True
            if name in ("p", "li", "td", "th", "tr", "option", "dt", "dd"):  # ends a sibling that was left open
                while stack and stack[-1][0] in ("p", name):
                    stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if not stack:
                heading = 0
            stack.append((name, inside, container, int(name[1]) if name in _HEADINGS else heading, _KINDS.get(name, kind)))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        state = stack[-1][1:] if stack else (False, -1, 0, 0)
    close()
    # A container with half of the page's words, or with all its articles, holds the article: its name says nothing.
    for c in range(len(around) - 1, 0, -1):
        if around[c] >= 0:
            words_in[around[c]] += words_in[c]
            inner_in[around[c]] += inner_in[c]
    total = sum(b.words for b in out)
    other: list[bool] = []
    for c, up in enumerate(around):
        most = 2 * words_in[c] >= total and (inner_in[c] > 0 or 10 * words_in[c] >= 9 * total)
        other.append(up >= 0 and other[up] or not (most or inner_in[c] == all_inner > 0 and 5 * words_in[c] >= total))
    for b, c in zip(out, placed, strict=True):
        b.outside = c >= 0 and other[c]
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "heading_before", "kind", "run", "inside", "outside")
NAMED = ("inside", "outside")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block. run: the words of plain blocks, which links do not fill, up to three places before and after it."""
    own = np.array([(b.words, b.linked / b.words, b.heading, b.kind, b.inside, b.outside) for b in found], float).reshape(-1, 6)
    n = len(own)
    edge = np.zeros((1, 3))
    before, after = np.vstack([edge, own[:-1, :3]])[:n], np.vstack([own[1:, :3], edge])[:n]
    plain = np.where(own[:, 1] < 0.5, own[:, 0], 0)
    sums = np.concatenate([[0], np.cumsum(plain)])
    at = np.arange(n)
    run = sums[np.minimum(at + 4, n)] - sums[np.maximum(at - 3, 0)]
    return np.column_stack([own[:, :2], before[:, :2], after[:, :2], own[:, 2], before[:, 2], own[:, 3], run, own[:, 4:]])


class DecisionTree:
    """Binary splits of least Gini impurity."""

    def __init__(self, depth: int = 14, least: int = 6):
        self.depth, self.least = depth, least
        self.nodes: list[tuple] = []  # feature, threshold, left, right; or -1, share of the positive

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.nodes = []
        self._grow(x, y.astype(float), 0)
        return self

    def _grow(self, x, y, depth) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, float(y.mean()), 0, 0))
        best = self._split(x, y) if depth < self.depth and 0 < y.mean() < 1 and len(y) >= 2 * self.least else None
        if best:
            k, cut = best
            low = x[:, k] <= cut
            left = self._grow(x[low], y[low], depth + 1)
            right = self._grow(x[~low], y[~low], depth + 1)
            self.nodes[me] = (k, cut, left, right)
        return me

    def _split(self, x, y):
        best, least = None, y.mean() * (1 - y.mean()) * len(y) - 1e-9
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, t = x[order, k], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
            if not ok.any():
                continue
            a, b = t[:-1], t[-1] - t[:-1]
            cost = np.where(ok, a * (n - a) / n + b * (len(y) - n - b) / (len(y) - n), np.inf)
            i = int(cost.argmin())
            if cost[i] < least:
                best, least = (k, (v[i] + v[i + 1]) / 2), cost[i]
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            k, cut, left, right = self.nodes[node]
            if k < 0:
                out[rows] = cut
            elif len(rows):
                low = x[rows, k] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out >= 0.5


_WRONG = ("content with-sidebar", "post has-comments", "social-story", "sidebar-layout", "no-ads", "article-list", "main-menu", "page", "box", "comment-free", "col-8", "share-buttons-top")


def labelled_blocks(pages: int = 5000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the blocks of written pages of several layouts, the training table; it has as many pages as are asked for, some 20 rows each. A
    third of the pages have no names, and a sixth of them have names that say the wrong thing, or anything."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300)]
    says = lambda a, b: " ".join(rng.choices(words, k=rng.randint(min(a, b), b)))
    x, y = [], []
    for _ in range(pages):
        layout = rng.choice(("tags", "tags", "classes", "plain", "plain", "wrong"))
        wrong = lambda kind: rng.choice(_WRONG)
        wrap = lambda tag, kind, inner: f"<{tag}>{inner}</{tag}>" if layout == "tags" else f'<div class="{kind if layout == "classes" else wrong(kind)}">{inner}</div>' if layout in ("classes", "wrong") else f"<div>{inner}</div>"  # noqa: E731, B023
        links = lambda: [f'<a href="/">@{says(1, 3)}</a>' for _ in range(rng.randint(2, 9))]  # noqa: E731, B023

        def menu() -> str:
            kind = rng.random()
            if kind < 0.6:
                return "<ul>" + "".join(f"<li>{x}</li>" for x in links()) + "</ul>"
            if kind < 0.8:
                return "<table><tr>" + "".join(f"<td>{x} {x}</td>" for x in links()) + "</table>"
            return f"<p>{' '.join(links())}</p>" if kind < 0.9 else f"<div>{' | '.join(links())}</div>"

        named = layout in ("tags", "classes")
        few = rng.random() < 0.12  # the article and nothing else
        brief = rng.random() < 0.15  # a heading with little below it
        boxed = lambda a, b: rng.choice((f"@{says(a, b)}", f"<p>@{says(a, b)}</p>"))
        parts = [f"<title>@{says(1, 20)}</title>"] if rng.random() < 0.9 else []
        if not few:
            if named or rng.random() < 0.3:
                parts.append(wrap("header", "site-header", f"<div>@{says(1, 4 if not named else 15)}</div>"))
            parts.append(wrap("nav", "menu", menu()))
            if rng.random() < 0.6:
                parts.append(f'<div class="{rng.choice(("ad", "notice", "cookie-banner", "promo"))}">{boxed(1, 40)}</div>')
        usual = lambda: rng.choice((8, 30, 60, 120)) if named else rng.choice((30, 60, 120))  # noqa: E731, B023
        body = f"<h1>={says(1, 16)}</h1>" if not named or rng.random() < (0.5 if few else 0.9) else ""
        body += "".join(
            f"<p>={says(1, 12)}</p>" if brief
            else f"<p>={says(1 if named and rng.random() < 0.3 else 15, usual())}" + (f' <a href="/">{says(1, 3)}</a> {says(5, 9)}' if rng.random() < 0.2 else "") + "</p>" if rng.random() < 0.8
            else f"<h2>={says(1, 6)}</h2>" if rng.random() < 0.5
            else f"<ul><li>={says(1 if named else 8, 20)}</li><li>={says(1 if named else 8, 20)}</li></ul>" if rng.random() < 0.5
            else f"<table><tr><td>={says(1, 9)}<td>={says(1, 9)}</table>" if named
            else f"<blockquote>={says(12, 50)}</blockquote>" if rng.random() < 0.5
            else f"<pre>={says(12, 40)}</pre>"
            for _ in range(rng.randint(1, 3) if brief else 1 if few and rng.random() < 0.4 else rng.randint(1, 12))
        )
        if named and not brief and rng.random() < 0.6:
            box = lambda: f'<div class="{rng.choice(("share", "related", "ad-slot", "newsletter"))}">{boxed(1, 12) if rng.random() < 0.6 else rng.choice(links())}</div>'  # noqa: E731, B023
            body += box() + (f"<p>={says(3, 60)}</p>" if rng.random() < 0.6 else "") + (box() if rng.random() < 0.4 else "")
        parts.append(wrap("article", "post-content", body))
        if not few:
            if named and rng.random() < 0.5:
                parts.append(wrap("aside", "comments", "".join(f"<p>@{says(1, 80)}</p>" for _ in range(rng.randint(1, 5)))))
            if rng.random() < 0.5:
                parts.append(wrap("aside", "sidebar", f"<h3>@{says(1, 3)}</h3>" + (menu() if rng.random() < 0.7 or not named else boxed(5, 60))))
            if rng.random() < 0.3:
                parts.append(f"<form><p>@{says(1, 12)}</p></form>")
            if rng.random() < 0.75 and (named or not brief):
                parts.append(wrap("footer", "footer", boxed(1, 40 if named else 10)))
        page = "".join(parts)
        found = blocks("<body>" + (f"<form>{page}</form>" if rng.random() < 0.05 else page) + "</body>")
        x.append(features(found))
        y += [b.text[0] == "=" for b in found]
    return np.vstack(x), np.array(y)


@lru_cache(maxsize=2)
def trained(pages: int = 5000, seed: int = 7) -> DecisionTree:
    return DecisionTree().fit(*labelled_blocks(pages, seed))


def main_text(html: str | None, tree: DecisionTree) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree.predict(features(found)), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", tree: DecisionTree | None = None) -> DataFrame:
    """pages with their main text: character references decoded, white space within a block as one space, blocks
    joined by line feeds. Null or empty html gives an empty text; a page cut short is read as far as it goes, and one of any length
    is read whole. No rows give no rows. Every other column stays, but one named like out is replaced; repeated rows get the same text."""
    need(pages, html_col)
    model = tree or trained()

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, model) for h in column], dtype=object)

    return pages.withColumn(out, text(F.col(html_col).cast("string")))
