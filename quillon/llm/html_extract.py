"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with their place in the tree.  A classifier's costs of calling a block content or
boilerplate are the capacities to the two terminals; neighbours in page order and blocks close in the tree are tied by
smoothness edges.  The minimum cut labels all blocks of a page at once.

The classifier is a logistic regression on a block's own figures and on names of its ancestors' tags and classes; it is
trained here, on pages that a generator writes with known labels, so no page of the corpus need be labelled.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never text of the page.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas select option datalist button textarea audio video map".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element that the start of another one ends.
ENDED_BY = {"p": BLOCKS - {"html", "body"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "option": frozenset({"option"})}
#: An element that holds its own paragraphs, list items or cells.
FENCE = {"p": frozenset(), "li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "option": frozenset()}

TAG_NAMES = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "figure", "table", "ul", "menu", "blockquote", "dialog", "address")
OWN_TAGS = ("p", "h1", "h2", "h3", "li", "div", "td", "pre", "blockquote", "figcaption")
#: Words of class, id and role attributes: of main text, and of what isn't.
GOOD_NAMES = ("article", "content", "post", "entry", "main", "story", "body", "text")
BAD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "consent", "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "respond", "reply", "discussion", "disqus", "sidebar", "side", "widget", "related", "recommended", "popular", "share", "social", "follow", "newsletter", "subscribe", "signup", "login", "search", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "masthead", "copyright", "legal", "disclaimer", "toolbar", "tags", "meta", "byline", "complementary", "contentinfo")

BAD, GOOD = frozenset(BAD_NAMES), frozenset(GOOD_NAMES)
#: A comment, a tag (an attribute's value is quoted, or goes up to white space or the tag's end), or a declaration.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|[^\s/><][^\s/>=<]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)>|<[!?][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)", re.I)
UNSHOWN = re.compile(r"aria-hidden\s*=\s*[\"']?true|\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Node:
    """An open element; what its blocks inherit is kept here, so a block costs the same at any depth."""

    name: str
    parent: Node | None
    depth: int
    tags: frozenset[str]  # its own and its ancestors'
    good: bool  # whether a class, id or role of these is of main text
    bad: bool


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    node: Node

    @property
    def tag(self) -> str:
        return self.node.name

    @property
    def tags(self) -> frozenset[str]:
        return self.node.tags


def attribute_names(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        found.update(NAME.findall((m[1] or m[2] or m[3] or "").lower()))
    return frozenset(found)


def is_hidden(attributes: str) -> bool:
    return bool(attributes) and (bool(HIDDEN.search(QUOTED.sub("", attributes))) or bool(UNSHOWN.search(attributes)))


class Reader:
    """Reads a page into blocks; tolerant of unclosed and stray tags."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, False
        self.root = Node("", None, 0, frozenset(), False, False)
        self.stack: list[Node] = [self.root]
        self.open: Counter[str] = Counter()
        self.skipped: list[str] = []  # elements open inside an unseen one, itself first
        self.last_end: dict[str, int] = {}

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.out.append(Block(text, self.linked, self.stack[-1]))
            self.pieces.clear()
        self.linked = 0

    def text(self, chunk: str) -> None:
        """A run of text, whose references are its own: one never goes on beyond a tag."""
        if chunk and not self.skipped:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            self.pieces.append(chunk)
            if self.in_link:
                self.linked += len(chunk)

    def close_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[node.name] -= 1
        del self.stack[depth:]

    def is_unclosed(self, name: str, at: int) -> bool:
        """Whether no end tag of this name follows."""
        if name not in self.last_end:
            self.last_end[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}[\s/>]", self.page, re.I)), default=-1)
        return self.last_end[name] < at

    def still_skipped(self, name: str, closing: bool, at: int, empty: bool) -> bool:
        """Follows a tag inside an unseen element; False where the tag ends that element and is to be read as any other.

        An unseen element ends with its end tag, where a tag that implies its end begins, with the end of an element around
        it, and, if it has no end tag at all, where a block begins.
        """
        inside = self.skipped
        if closing:
            if name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name) :]
                return True
            if self.open[name]:
                inside.clear()
                return False
            return True
        while inside and name in ENDED_BY.get(inside[-1], ()):
            inside.pop()
        if inside and name in BLOCKS and inside[0] in UNSEEN and self.is_unclosed(inside[0], at):
            inside.clear()
        if not inside:
            return False
        if not empty:
            inside.append(name)
        return True

    def start(self, name: str, attributes: str) -> None:
        for tag, enders in ENDED_BY.items():
            if name in enders and self.open[tag]:
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].name == tag:
                        self.close_to(i)
                        break
                    if self.stack[i].name in FENCE[tag]:
                        break
        if name == "hr":
            return
        over, own = self.stack[-1], attribute_names(attributes)
        tags = over.tags if name in over.tags else over.tags | {name}
        self.stack.append(Node(name, over, over.depth + 1, tags, over.good or not GOOD.isdisjoint(own), over.bad or not BAD.isdisjoint(own)))
        self.open[name] += 1

    def tag(self, name: str, closing: bool, attributes: str, at: int) -> str | None:
        """Follows a tag; the name of an element whose content is to be passed over up to its end tag, if it begins one."""
        empty = name in EMPTY or attributes.endswith("/") and name in ("svg", "math")
        if self.skipped and self.still_skipped(name, closing, at, empty or name in RAW):
            return name if name in RAW and not closing else None
        if name in RAW and not closing:
            return name
        if name == "head":
            return None
        if not closing and not empty and (name in UNSEEN or is_hidden(attributes)):
            if name in BLOCKS:
                self.end_block()
                self.start(name, "")  # for the ends that it implies
                self.close_to(len(self.stack) - 1 if self.stack[-1].name == name else len(self.stack))
            self.skipped.append(name)
        elif name == "br":
            self.pieces.append(" ")
        elif name == "a":
            self.in_link = not closing
        elif name in BLOCKS:
            self.end_block()
            self.in_link = False
            if not closing:
                self.start(name, attributes)
            elif self.open[name]:
                self.close_to(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].name == name))
        return None

    def read(self) -> list[Block]:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            m = TOKEN.search(page, at)
            if m is None:
                self.text(page[at:])
                break
            self.text(page[at : m.start()])
            at = m.end()
            if m[2] is not None:
                over = self.tag(m[2].lower(), bool(m[1]), m[3], at)
                if over:
                    stop = RAW_END[over].search(page, at)
                    at = stop.end() if stop else end
        self.end_block()
        return self.out


RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in RAW}


def blocks_of(page: str | None) -> list[Block]:
    """Blocks with text, in page order."""
    return Reader(page or "").read()


COLUMNS = ("bias", "log_chars", "link_share", "stops", "short", "first", "last", *(f"in_{t}" for t in TAG_NAMES), *(f"is_{t}" for t in OWN_TAGS), "good_name", "bad_name", "legal_sign")


def block_features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(COLUMNS)), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        chars = len(b.text)
        words = b.text.count(" ") + 1
        x[i, :7] = (1, np.log1p(chars) / 5, min(1, b.linked / chars), min(1, sum(b.text.count(c) for c in ".,;:!?") / words * 4), words < 5, i == 0, i == n - 1)
        x[i, 7 : 7 + len(TAG_NAMES)] = [t in b.tags for t in TAG_NAMES]
        at = 7 + len(TAG_NAMES)
        x[i, at : at + len(OWN_TAGS)] = [t == b.tag for t in OWN_TAGS]
        x[i, -3:] = (b.node.good, b.node.bad, "©" in b.text)
    return x


def written_pages(count: int = 400, seed: int = 11) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Pages with labelled blocks: articles in varied wrappers among menus, notices, adverts, forms and comments."""
    r = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(letters[k] for k in r.integers(0, 26, r.integers(2, 9)))
    prose = lambda n: " ".join(word() + ("," if r.random() < 0.1 else ".") * (r.random() < 0.2) for _ in range(n)) + "."
    phrase = lambda: " ".join(word() for _ in range(r.integers(1, 5)))
    marked, junk = "\ue000", "\ue001"  # private characters tell the parts of a written page

    def menu(tag: str, name: str) -> str:
        items = "".join(f'<li><a href="/{word()}">{junk}{phrase()}</a></li>' for _ in range(r.integers(3, 9)))
        return f"<{tag}{name}><ul>{items}</ul></{tag}>"

    def attribute(names: tuple[str, ...]) -> str:
        return f' {r.choice(["class", "id"])}="{r.choice(names)}"'

    def boilerplate(kind: str) -> str:
        if kind in ("nav", "menu"):
            return menu(kind, attribute(BAD_NAMES) if r.random() < 0.3 else "")
        if kind == "aside":
            return f"<aside>{junk}{phrase()}<p>{junk}{prose(r.integers(3, 40))}</p></aside>"
        if kind == "form":
            return f"<form><p>{junk}{prose(r.integers(3, 15))}</p><div>{junk}{phrase()}</div></form>"
        if kind in ("header", "footer"):
            sign = "&copy; " if r.random() < 0.5 else ""
            return f"<{kind}><div>{junk}{sign}{prose(r.integers(2, 30))}</div></{kind}>" if r.random() < 0.5 else f"<{kind}>{junk}{sign}{prose(r.integers(2, 25))}</{kind}>"
        if kind == "list":
            return menu("div", attribute(BAD_NAMES))
        inner = "".join(f"<p>{junk}{prose(r.integers(2, 60))}</p>" for _ in range(r.integers(1, 4)))
        return f"<div{attribute(BAD_NAMES)}>{inner}</div>" if r.random() < 0.7 else f"<div{attribute(BAD_NAMES)}>{junk}{prose(r.integers(2, 50))}</div>"

    kinds = ("nav", "menu", "aside", "form", "header", "footer", "list", "named", "named", "named")
    for _ in range(count):
        body = [f"<h1>{marked}{phrase()}</h1>"] if r.random() < 0.8 else []
        bare = r.random() < 0.25  # text in divisions instead of paragraphs
        for _ in range(r.integers(1, 9)):
            shape = r.random()
            if bare and shape < 0.85:
                body.append(f"<div>{marked}{prose(r.integers(5, 90))}</div>" if shape < 0.6 else f"{marked}{prose(r.integers(10, 90))}<br><br>{prose(r.integers(3, 60))}")
            elif shape < 0.75:
                body.append(f"<p>{marked}{prose(r.integers(1, 90))}</p>")
            elif shape < 0.85:
                body.append(f"<h2>{marked}{phrase()}</h2><p>{marked}{prose(r.integers(3, 60))}</p>")
            elif shape < 0.93:
                body.append("<ul>" + "".join(f"<li>{marked}{prose(r.integers(1, 20))}</li>" for _ in range(3)) + "</ul>")
            else:
                body.append(f"<blockquote>{marked}{prose(r.integers(3, 40))}</blockquote>")
            if r.random() < 0.15:
                body.append(boilerplate(str(r.choice(("named", "aside", "form")))))
        wrap = r.random()
        inner = "".join(body)
        if wrap < 0.4:
            inner = f"<article>{inner}</article>"
        elif wrap < 0.6:
            inner = f"<main>{inner}</main>"
        elif wrap < 0.8:
            inner = f"<div{attribute(GOOD_NAMES)}>{inner}</div>"
        elif wrap < 0.88:
            inner = f"<section>{inner}</section>"
        elif wrap < 0.94:
            inner = f"<table><tr><td{attribute(BAD_NAMES)}>{junk}{phrase()}</td><td>{inner}</td></tr></table>"
        elif wrap < 0.98:
            inner = f"<div><div>{inner}</div></div>"
        before = [boilerplate(str(r.choice(kinds))) for _ in range(r.integers(0, 4))]
        after = [boilerplate(str(r.choice(kinds))) for _ in range(r.integers(0, 4))]
        found = blocks_of("<html><body>" + "".join(before) + inner + "".join(after) + "</body></html>")
        labels = np.array([marked in b.text for b in found], float)
        for b in found:
            b.text = b.text.replace(marked, "").replace(junk, "")
        yield found, labels


@lru_cache(maxsize=1)
def classifier() -> np.ndarray:
    """Weights of COLUMNS, by Newton steps with a ridge."""
    made = list(written_pages())
    x = np.vstack([block_features(b) for b, _ in made]).astype(float)
    y = np.concatenate([label for _, label in made])
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
    return w


@dataclass(frozen=True)
class CutSettings:
    adjacent: float = 0.3  # tie of neighbours in page order
    family: float = 1.2  # tie of neighbours with one parent; divided by their distance in the tree otherwise
    most: float = 12.0  # that a terminal's cost can be


def steps_between(a: Node, b: Node) -> int:
    """Length of the way from one element to another in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(blocks: list[Block], s: CutSettings) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next one, and to the next one of the same parent."""
    out: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out[i - 1, i] = s.adjacent + s.family / (1 + steps_between(blocks[i - 1].node, b.node)) ** 2
        parent = id(b.node.parent or b.node)
        before = last_of.get(parent)
        if before is not None:
            out[before, i] = out.get((before, i), 0) + s.family
        last_of[parent] = i
    return [(a, b, w) for (a, b), w in out.items()]


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: content) of the least cut.  gain: cost of calling a block boilerplate less that of content.

    A block whose own gain outweighs all its edges keeps that label in every least cut; such blocks are settled first and
    their edges become gains of their neighbours.  What is left is cut by augmenting paths, shortest first.
    """
    gain = np.array(gain, float)
    n = len(gain)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        around[a][b] = around[a].get(b, 0) + w
        around[b][a] = around[b].get(a, 0) + w
    label = np.zeros(n, bool)
    weight = [sum(x.values()) for x in around]
    left = set(range(n))
    todo = deque(left)
    while todo:
        i = todo.popleft()
        if i not in left or abs(gain[i]) < weight[i]:
            continue
        left.discard(i)
        label[i] = gain[i] > 0
        for j, w in around[i].items():
            if j in left:
                gain[j] += w if label[i] else -w
                weight[j] -= w
                todo.append(j)
    while left:
        part, todo = set(), deque([left.pop()])
        while todo:
            i = todo.popleft()
            part.add(i)
            near = left.intersection(around[i])
            left -= near
            todo.extend(near)
        label[cut_part(part, gain, around)] = True
    return label


def cut_part(nodes: set[int], gain: np.ndarray, around: list[dict[int, float]]) -> list[int]:
    """The content nodes of the least cut of one connected part."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {v: {} for v in (*nodes, source, sink)}
    for i in sorted(nodes):
        if gain[i] > 0:
            room[source][i], room[i][source] = float(gain[i]), 0.0
        else:
            room[i][sink], room[sink][i] = float(-gain[i]), 0.0
        for j, w in around[i].items():
            if j in nodes:
                room[i][j] = w
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            return [i for i in nodes if i in came]
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow


def main_text(page: str | None, weights: np.ndarray | None = None, s: CutSettings = CutSettings()) -> str:
    """The content blocks of a page, one to a line; empty where there are none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    gain = np.clip(block_features(blocks) @ (classifier() if weights is None else weights), -s.most, s.most)
    keep = minimum_cut(gain, ties(blocks, s))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """pages without the column page, plus the main text: empty for null, empty or textless pages.  A column named like
    the result is replaced."""
    kept = [f for f in pages.schema if f.name not in (page, into)]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{into}` string"])
    weights = classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x, weights) for x in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string())], [*names, into])

    return pages.select(*names, page).mapInArrow(run, schema)
