"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A logistic classifier over a block's text, links, tag, place and
surroundings gives the cost of calling it content or boilerplate; these costs are the capacities to the two
terminals. Neighbouring blocks, and blocks under one parent, are joined by edges whose capacity is the cost of
labelling them differently. The minimum cut is found by max-flow, after blocks whose own cost outweighs all
their edges are settled (which never changes the cut).

The classifier's weights are fitted by `fit_html.py` on page layouts that it makes up, most of them without landmarks or
telling class names, so that no feature decides alone. Words of class, id and role are read as English compounds: the
last word that isn't a mere container names the thing ("user-thread" is a thread, "share-story" a story), and an element
that holds most of a page's text isn't a part beside it whatever its name.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "object", "audio", "video", "canvas")
#: Attributes: a quoted value counts as one where a space, slash or the tag's end follows its last quote; a quote that
#: nothing closes so is a character as any, and its tag ends at the next >.
_ATTRS = r"""(?:=\s*+"[^"]*"(?=[\s/>])|=\s*+'[^']*'(?=[\s/>])|[^>])*+"""
#: An empty element of its own: the last slash isn't part of an unquoted value.
_CLOSED_SVG = r"""<svg(?=[\s/])(?:=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)|/(?!>)|[^>=/])*+/>"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|" + _CLOSED_SVG + "|<(" + "|".join(_RAW) + r")\b" + _ATTRS + r"(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<[!?](?:[^>])*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + _ATTRS + r")(?:>|\Z)",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_TAG = frozenset("nav footer aside form menu head title button fieldset dialog search".split())
_GOOD_TAG = frozenset("article main".split())
#: Words of class, id and role that name what surrounds an article.
_BAD_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs captcha comment comments commentlist complementary "
    "consent contentinfo cookie cookies disclaimer discussion disqus dropdown feedback footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice "
    "notification overlay pager pagination popup popular promo promoted promotion reactions recommended related replies reply respond responses reviews search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription tags thread threads toolbar topbar trending widget widgets".split()
)
_GOOD_WORD = frozenset("article articlebody body content entry hentry main post story text".split())
#: Words that say what an element does to the page's layout, not what it holds.
_CONTAINER = frozenset(
    "area bar block body bottom box col column container content center element footer group grid head holder inner item items layout left list module outer panel placeholder region right row section "
    "slot top unit wrap wrapper".split()
)
#: A class that begins so tells of something elsewhere on the page.
_TELLS = frozenset("has is no not with without".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
_CLOSES_P = _BLOCK - {"button", "option", "body", "html", "head", "title"}

FEATURES = (
    "bias", "words", "stops", "links", "paragraph", "heading", "item", "few_words", "container_share", "good_tag", "good_name", "bad_tag", "page_header", "bad_name", "bad_word", "bad_inside_good",
)
#: Fixed values, fitted by fit_html.py.
WEIGHTS = np.array([0.23, -4.51, 4.83, -10.95, -0.55, 1.25, 4.12, -0.43, 10.55, 4.26, 4.31, -8.4, -0.52, -13.51, -1.72, -6.13])


@dataclass
class Block:
    text: str
    parent: int
    tag: str
    linked: int
    container: int  # the element around it, or around the paragraph, heading or item that it is
    margin: float = 0.0


@dataclass
class Page:
    """Blocks, and for each element its parent and what its tag and names say."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    marks: list[tuple[bool, ...]] = field(default_factory=lambda: [(False,) * 6])  # good tag, good name, bad tag, header, bad name, bad word


def _names(attrs: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role name content, name boilerplate, or hold a word of boilerplate beside the name."""
    good = bad = word = False
    for m in _HINT.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [w.lower() for w in _WORD.findall(name)]
            if not parts or parts[0] in _TELLS:
                continue
            core = list(parts)
            while len(core) > 1 and core[-1] in _CONTAINER:
                core.pop()
            good = good or core[-1] in _GOOD_WORD
            bad = bad or core[-1] in _BAD_WORD
            word = word or any(w in _BAD_WORD for w in parts[:-1])
    return good, bad, word


def parse(page: str) -> Page:
    """Blocks of text in page order: references decoded, white space made single, empty ones left out."""
    out = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                tag, e = stack[-1]
                out.blocks.append(Block(text, e, tag, linked, out.parent[e] if tag in _LEAF else e))
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if m[2]:  # closing
            if tag in _BLOCK:
                flush()
            if tag == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body", "table") and tag not in _BLOCK:
                    break
            continue
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES_P:
                while len(stack) > 1 and stack[-1][0] == "p":
                    stack.pop()
            if tag in ("li", "dd", "dt", "option", "td", "th", "tr") and stack[-1][0] == tag:
                stack.pop()
            if tag == "body":
                while len(stack) > 1 and stack[-1][0] in ("head", "title"):
                    stack.pop()
            if tag not in _VOID and not m[4].endswith("/"):
                good, bad, word = _names(m[4]) if "=" in m[4] and tag not in ("html", "body") else (False,) * 3
                out.parent.append(stack[-1][1])
                out.marks.append((tag in _GOOD_TAG, good, tag in _BAD_TAG, tag == "header", bad, word))
                if tag == "header":  # that of an article is its own
                    k = stack[-1][1]
                    while k and not (out.marks[k][0] or out.marks[k][1]):
                        k = out.parent[k]
                    if k:
                        out.marks[-1] = (False, good, False, False, False, word)
                stack.append((tag, len(out.parent) - 1))
        elif tag == "a":
            in_link += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def features(page: Page) -> np.ndarray:
    """Blocks x FEATURES."""
    n, blocks = len(page.parent), page.blocks
    size = [0] * n
    for b in blocks:
        size[b.parent] += len(b.text) - min(b.linked, len(b.text))
    for e in range(n - 1, 0, -1):  # a parent has a smaller number
        size[page.parent[e]] += size[e]
    whole = max(1, size[0])
    state = [(False,) * 7] * n
    for e in range(1, n):
        good_tag, good_name, bad_tag, header, bad_name, bad_word, inside = state[page.parent[e]]
        own_good_tag, own_good, own_bad_tag, own_header, own_bad, own_word = page.marks[e]
        share = size[e] / whole
        worse = own_bad_tag or own_bad and share <= 0.9
        state[e] = (
            good_tag or own_good_tag, good_name or own_good and not own_bad, bad_tag or own_bad_tag, header or own_header, bad_name or own_bad and share <= 0.9, bad_word or own_word and share <= 0.5,
            inside or worse and (good_tag or good_name),
        )
    x = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        stops = sum(map(b.text.count, ".,;:?!"))
        x[i, :9] = (
            1, min(np.log1p(words), 5) / 5, min(stops, 8) / 8, min(1.0, b.linked / len(b.text)), b.tag in ("p", "blockquote", "pre"), b.tag in ("h1", "h2", "h3"),
            b.tag in ("li", "option", "button", "dt"), words <= 3, min(0.5, size[b.container] / whole),
        )
        x[i, 9:] = state[b.parent]
    return x


def blocks(page: str) -> list[Block]:
    """The blocks of a page with their margins: log-odds that a block is content."""
    parsed = parse(page)
    for b, m in zip(parsed.blocks, (features(parsed) @ WEIGHTS).tolist(), strict=True):
        b.margin = m
    return parsed.blocks


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise sum of |unary| where the sign is denied plus capacities of cut edges.

    A node whose unary outweighs its open edges takes its own label, and passes their capacity on to its
    neighbours; what stays open is solved by max-flow. A tie is boilerplate.
    """
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                u[j] += c if label[i] else -c
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in _source_side(rest, u, near):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], u: list[float], near: list[dict[int, float]]) -> list[int]:
    """Nodes on the content terminal's side after max-flow by shortest augmenting paths."""
    src, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    cap[src], cap[sink] = {}, {}
    for i in nodes:
        if u[i] > 0:
            cap[src][i] = u[i]
            cap[i][src] = 0.0
        elif u[i] < 0:
            cap[i][sink] = -u[i]
            cap[sink][i] = 0.0
    while True:
        level = {src: 0}
        queue = deque([src])
        while queue:
            x = queue.popleft()
            for y, c in cap[x].items():
                if c > 1e-9 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if sink not in level:
            return [i for i in nodes if i in level]
        todo = {x: iter(list(cap[x])) for x in level}
        path = [src]
        while path:
            x = path[-1]
            if x == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                back = len(path)
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= 1e-9:
                        back = min(back, k + 1)
                del path[back:]
                continue
            for y in todo[x]:
                if cap[x].get(y, 0.0) > 1e-9 and level.get(y, -1) == level[x] + 1:
                    path.append(y)
                    break
            else:
                path.pop()


#: Cost of labelling differently: blocks that follow each other in the page, and those that do in one container.
ADJACENT, SIBLING = 0.6, 3.0


def edges_of(found: list[Block], adjacent: float = ADJACENT, sibling: float = SIBLING) -> list[tuple[int, int, float]]:
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, adjacent))
        if b.container in last:
            edges.append((last[b.container], i, sibling))
        last[b.container] = i
    return edges


def extract(page: str | None, adjacent: float = ADJACENT, sibling: float = SIBLING) -> str:
    """Content blocks in page order, joined by line ends; empty for null, empty or textless pages.

    A block whose costs are equal is boilerplate. A line break (br) is white space inside its block.
    """
    found = blocks(page or "")
    keep = min_cut([b.margin for b in found], edges_of(found, adjacent, sibling))
    return "\n".join(b.text for b, ok in zip(found, keep, strict=True) if ok)


def main_text(pages: DataFrame, html_col: str = "html", adjacent: float = ADJACENT, sibling: float = SIBLING) -> DataFrame:
    """page_id, url, text (empty if none), n_chars (its code points) of every row of pages.

    Null html is empty; null ids and urls pass through; rows that repeat an id are rows as any; a very long page is read
    whole, in memory that follows its length; other columns are not looked at.
    """

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py(), adjacent, sibling) for x in col], pa.string())

    out = pages.select("page_id", "url", run(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
