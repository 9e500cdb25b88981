"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks of text. What the markup says (elements, roles, names of classes) and a
classifier of the text itself give every block a log-odds of being content: its capacity to one of the two
terminals. Neighbouring blocks, and neighbours under one parent, are tied by smoothness edges that weaken with
their distance in the tree. The minimum cut, found by maximum flow, separates content from boilerplate.

The classifier is a logistic regression on a few coarse traits of a block. It learns from all pages: blocks whose
markup leaves no doubt are counted per combination of traits (some hundred counters), never collected.

Defined results: null, empty and blank pages, and pages without content, give an empty text; repeated rows are
separate rows; null ids and urls are kept; an unclosed tag, comment or raw element reaches to the end of the
page, as in browsers; pages of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TIE = 1.0                        # capacity between two neighbours under one parent
CLEAR, NAMED = 12.0, 8.0         # evidence of an element or role, and of a class or id
INSIDE = 4.0                     # evidence of standing in an article
TEXT_LIMIT = 3.0                 # the text alone says at most this much
PRIOR_STRENGTH = 1.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")

RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "xmp", "object", "svg", "math", "canvas", "audio", "video", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "nobr", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "br", "wbr", "img"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# an open element ends where one of these begins inside the same parent
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
        "th": {"td", "th", "p"}, "option": {"option"}, "a": {"a"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "aside", "nav", "header", "footer", "form", "blockquote", "body", "td", "th"}

# elements and roles that never hold main text, and those that name it
NOT_MAIN = {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "datalist", "dialog", "menu", "noscript", "fieldset", "head"}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar",
             "menuitem", "toolbar", "tablist", "status", "tooltip"}
ROLES_IN = {"main", "article"}
# parts of class names and ids
NAMES_OUT = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion",
             "banner", "sidebar", "rail", "widget", "widgets", "aside", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs",
             "pagination", "pager", "toolbar", "topbar", "header", "masthead", "footer", "copyright", "legal", "disclaimer", "cookie", "cookies",
             "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
             "login", "search", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "teaser", "teasers", "skip",
             "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "reviews", "outbrain", "taboola", "hidden"}
NAMES_TALK = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "reviews"}
NAMES_IN = {"article", "content", "post", "entry", "story", "articlebody", "maincontent", "main"}

TRAITS = {"words": 6, "links": 4, "stop": 2, "tag": 5, "sign": 2}
# log-odds before any page was read
PRIOR = {"words": (-1.5, -1.0, -0.3, 0.5, 1.2, 1.5), "links": (0.5, 0.3, -0.8, -2.0), "stop": (-0.5, 0.7), "tag": (0.7, 0.5, -0.5, -0.2, -0.3), "sign": (0.1, -1.5)}


@dataclass(slots=True)
class _Element:
    name: str
    depth: int
    number: int
    parent: int                  # number of the parent element
    block: bool
    verdict: int = 0             # 1 in an article, -1 outside, whatever class names say
    hidden: bool = False
    named: tuple[int, ...] = ()  # elements above whose name says that they are outside
    link: bool = False


@dataclass(slots=True)
class Block:
    text: str
    links: int                   # characters inside links
    parent: int
    path: tuple[int, ...]
    tag: str
    verdict: int                 # as above, -2 outside by name
    named: tuple[int, ...]


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _judged(name: str, attributes: dict[str, str], above: _Element) -> tuple[int, bool]:
    """(verdict, whether a class or id says outside) of an element under ``above``."""
    role = attributes.get("role", "").strip().lower()
    parts = set(_SPLIT.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) - {""}
    main = name in ("article", "main") or role in ROLES_IN or attributes.get("itemprop") == "articleBody"
    if name in ("html", "body"):
        return above.verdict, False
    if name in NOT_MAIN or role in ROLES_OUT:
        return -1, False
    if name == "header" and above.verdict != 1:
        return -1, False
    if above.verdict < 0:
        return above.verdict, False
    if main:
        return (-1 if parts & (NAMES_TALK | {"ad", "advert", "promo", "teaser", "related", "sponsored"}) else 1), False
    if parts & NAMES_TALK:
        return -1, False
    if parts & NAMES_OUT:
        return above.verdict, True
    if name in HEADINGS or name == "p":
        return above.verdict, False
    return (1 if parts & NAMES_IN else above.verdict), False


def parse(source: str) -> Page:
    """Blocks of a page in order: stretches of text that no block element interrupts."""
    page = Page()
    root = _Element("#root", 0, 0, -1, True)
    stack, opened = [root], Counter()
    pieces: list[tuple[str, bool]] = []
    at = 0

    def flush() -> None:
        if not pieces:
            return
        owner = next(e for e in reversed(stack) if e.block)
        whole = " ".join("".join(p for p, _ in pieces).split())
        if whole and not stack[-1].hidden:
            links = sum(len(" ".join(p.split())) for p, linked in pieces if linked)
            page.blocks.append(Block(whole, min(links, len(whole)), owner.parent, (owner.number,), owner.name, stack[-1].verdict, stack[-1].named))
        pieces.clear()

    def pop_to(k: int) -> None:
        if any(e.block for e in stack[k:]):
            flush()
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    def text(raw: str) -> None:
        if raw:
            pieces.append((html.unescape(raw), stack[-1].link))

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue                               # inside a raw element
        text(source[at:m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                pieces.append((" ", False))
            elif opened[name]:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name)
                if not (name in INLINE and any(e.block for e in stack[k + 1:])):
                    pop_to(k)
            elif name not in INLINE:
                flush()
        elif m[2]:
            name = m[2].lower()
            if name in RAW:
                if name not in ("svg", "math") or not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = end.start() if end else len(source)
                if name not in INLINE:
                    flush()
                continue
            if name in ENDS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in ENDS[name]:
                        if name != "a" or not any(e.block for e in stack[i + 1:]):
                            pop_to(i)
                            break
                    if stack[i].name in SCOPE and stack[i].name not in ENDS[name]:
                        break
            elif name not in INLINE and opened["p"] and (stack[-1].name == "p" or not any(e.name in SCOPE for e in stack[-8:])):
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p"))
            inline = name in INLINE
            if not inline:
                flush()
            if name == "br":
                pieces.append((" ", False))
            if name in VOID:
                continue
            above = stack[-1]
            if inline and name != "a" and "class" not in m[3] and "id" not in m[3] and "style" not in m[3]:
                verdict, by_name, hidden, number = above.verdict, False, above.hidden, above.number
            else:
                attributes = _attributes(m[3]) if m[3] else {}
                verdict, by_name = _judged(name, attributes, above)
                style = attributes.get("style", "").replace(" ", "").lower()
                hidden = above.hidden or "hidden" in attributes or "display:none" in style or "visibility:hidden" in style
                number = above.number
            if not inline:
                number = len(page.parents)
                page.parents.append(above.number)
                page.depths.append(page.depths[above.number] + 1)
            stack.append(_Element(name, 0, number, above.number, not inline, verdict, hidden, (*above.named, number) if by_name else above.named, above.link or name == "a"))
            opened[name] += 1
    text(source[at:])
    flush()
    _spare_wrappers(page)
    return page


def _spare_wrappers(page: Page) -> None:
    """Blocks under a name that says outside are outside.

    Not so under a name such as "layout-sidebar" on a wrapper of most of the page's text and of its article or title.
    """
    size = sum(len(b.text) for b in page.blocks)
    inside: Counter[int] = Counter()
    whole: set[int] = set()
    for b in page.blocks:
        for k in b.named:
            inside[k] += len(b.text) - b.links
            if b.verdict == 1 or b.tag == "h1":
                whole.add(k)
    spared = {k for k in whole if 2 * inside[k] > size}
    for b in page.blocks:
        if b.verdict != -1 and not spared.issuperset(b.named):
            b.verdict = -2


_WORD_BINS = (3, 6, 11, 21, 41)
_STOPS = tuple(".!?…:;。！？\"”»")
_SIGN = re.compile(r"©|\(c\)|all rights reserved|copyright|https?://|\|", re.I)


def traits(block: Block) -> tuple[int, ...]:
    """Coarse traits of the text, in the order of TRAITS."""
    words = block.text.count(" ") + 1
    share = block.links / len(block.text)
    return (bisect_right(_WORD_BINS, words),
            0 if share == 0 else 1 if share <= 0.3 else 2 if share <= 0.7 else 3,
            int(block.text.endswith(_STOPS)),
            0 if block.tag == "p" else 1 if block.tag in HEADINGS else 2 if block.tag in ("li", "dt", "dd") else 3 if block.tag in ("td", "th") else 4,
            int(bool(_SIGN.search(block.text[:200]) or _SIGN.search(block.text[-200:]))))


class TextModel:
    """Logistic regression on one-hot traits with a Gaussian prior about PRIOR."""

    def __init__(self, weights: np.ndarray | None = None):
        self.starts = np.concatenate(([0], np.cumsum(list(TRAITS.values()))[:-1]))
        self.prior = np.concatenate([PRIOR[k] for k in TRAITS])
        self.weights = self.prior if weights is None else weights
        self._known: dict[tuple[int, ...], float] = {}

    def logit(self, found: tuple[int, ...]) -> float:
        if found not in self._known:
            self._known[found] = float(self.weights[self.starts + found].sum())
        return self._known[found]

    @classmethod
    def learned(cls, counted: list[tuple[tuple[int, ...], int, int]]) -> TextModel:
        """From (traits, blocks of content, blocks of boilerplate), both sides weighing alike: Newton steps."""
        model = cls()
        if not counted:
            return model
        x = np.zeros((len(counted), len(model.prior)))
        for i, (found, _, _) in enumerate(counted):
            x[i, model.starts + np.array(found)] = 1
        yes, no = (np.array([c[k] for c in counted], float) for k in (1, 2))
        if not yes.sum() or not no.sum():
            return model
        mass = min(yes.sum() + no.sum(), 10_000)
        yes, no = yes * (mass / 2 / yes.sum()), no * (mass / 2 / no.sum())
        w = model.prior.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (yes - (yes + no) * p) - PRIOR_STRENGTH * (w - model.prior)
            bend = x.T @ (x * ((yes + no) * p * (1 - p))[:, None]) + PRIOR_STRENGTH * np.eye(len(w))
            step = np.linalg.solve(bend, slope)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        return cls(w)


def cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Content side of the minimum cut: odds > 0 are capacities from the source, odds < 0 to the sink.

    A block whose own capacity is at least that of all its ties is on its own side in some minimum cut; it is
    set first, its ties become capacities of its neighbours, and the flow runs over the rest.
    """
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in ties:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if side[i] is None and odds[i] and abs(odds[i]) >= sum(near[i].values()):
            side[i] = odds[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                odds[j] += c if side[i] else -c
                waiting.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, content in zip(rest, _max_flow(rest, odds, near)):
            side[i] = content
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; whether each node can be reached from the source at the end."""
    place = {i: k for k, i in enumerate(nodes)}
    n, source, sink = len(nodes) + 2, len(nodes), len(nodes) + 1
    out: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, k in place.items():
        if odds[i] > 0:
            edge(source, k, odds[i], 0.0)
        elif odds[i] < 0:
            edge(k, sink, -odds[i], 0.0)
        for j, c in near[i].items():
            if i < j:
                edge(k, place[j], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[place[i]] >= 0 for i in nodes]
        tried = [0] * n
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(x for x, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
            elif tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    tried[a] += 1
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
            else:
                break


def _apart(page: Page, a: int, b: int) -> int:
    """Steps between two elements in the tree."""
    parents, depths, steps = page.parents, page.depths, 0
    while a != b:
        if depths[a] < depths[b]:
            a, b = b, a
        a = parents[a]
        steps += 1
    return steps


def ties_of(page: Page) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between a block and the one before it under the same parent."""
    last: dict[int, int] = {}
    ties = []
    for i, b in enumerate(page.blocks):
        if i:
            steps = _apart(page, page.blocks[i - 1].path[0], b.path[0])
            ties.append((i - 1, i, 2 * TIE / max(2, steps)))
        before = last.get(b.parent, i - 1)
        if before < i - 1:
            ties.append((before, i, TIE))
        last[b.parent] = i
    return ties


def evidence(block: Block) -> float:
    return (0.0, INSIDE, -NAMED, -CLEAR)[block.verdict]


def content(source: str | None, model: TextModel) -> list[str]:
    """Texts of the content blocks of a page."""
    page = parse(source or "")
    odds = [evidence(b) + max(-TEXT_LIMIT, min(TEXT_LIMIT, model.logit(traits(b)))) for b in page.blocks]
    return [b.text for b, inside in zip(page.blocks, cut(odds, ties_of(page))) if inside]


def fit(pages: DataFrame) -> TextModel:
    """The text model of all pages (html); a bounded number of counters reaches the driver (an action)."""
    names = list(TRAITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                for b in parse(source or "").blocks:
                    if b.verdict:
                        seen[(*traits(b), int(b.verdict > 0))] += 1
        columns = list(zip(*seen)) or [[] for _ in range(len(names) + 1)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], pa.array(list(seen.values()), pa.int64())], names=[*names, "inside", "n"])

    found = pages.select("html").mapInArrow(run, ", ".join(f"{c} int" for c in [*names, "inside"]) + ", n long")
    sides = [F.sum(F.when(F.col("inside") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "yes"), (0, "no"))]
    rows = found.groupBy(*names).agg(*sides).collect()          # at most one per combination of traits
    return TextModel.learned([(tuple(r[c] for c in names), r["yes"], r["no"]) for r in sorted(rows)])


def extract(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, url, text, n_chars) of all rows of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(content(source, model)) for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
