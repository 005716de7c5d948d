"""Main text of web pages by wrapper induction.

One page of each host, the middle one in size of a few, is the host's frame. Every page of the host is aligned with it
by simple tree matching: equal-labelled nodes are paired in order so that most nodes match. Each block of text
of a page then has a place in the frame, and the places' figures are summed over all different pages of the host:

- A text that stands at one place on most pages is constant: template.
- The article's node is found going down the frame, from each node to the child that holds nearly all of the varying,
  unlinked text of all pages, and no further once it is spread.
- What recurs outside of that node, and small or linked boxes before and after the text in it, are template, whether
  their own text varies or not. Slots that vary inside it are the content.

The wrapper of a host is that verdict on each place. A page that shows nothing at the content places, or whose host has
fewer than CONSTANT_IN different pages, is judged by its own tree in the same way, with itself as the frame.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, written

#: Different pages of a host from which its frame is chosen; all its pages are aligned with the frame and counted.
REFERENCES = 6
#: A host of fewer different pages has no wrapper. A text is constant if it stands at its place on so many pages and
#: on this share of those that have the place.
CONSTANT_IN, CONSTANT_SHARE = 3, 0.5
#: The share of a node's varying text below which a box in it is small.
SMALL = 0.1
#: Keys of the pages that frames are chosen from are broadcast up to this many.
BROADCAST_KEYS = 100_000
#: All frames are broadcast up to this many bytes; beyond, pages meet them by host and salt.
BROADCAST_BYTES = 48 << 20
SALT_ROWS = 4_000
#: Elements that are nested deeper are laid side by side in the node of this depth; they stay noise below noise.
DEPTH = 256
#: Lists of children of more pairs than this are aligned by rows of numpy (the way moves cost only, never a result).
CELLS = 40_000
#: Cells of such rows that are worked on or remembered at once.
SWEEP = 1_000_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROP = frozenset(
    "script style noscript template iframe object embed svg math canvas form button select textarea input option datalist "
    "nav header footer aside dialog menu head title audio video map".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul caption option select textarea title".split()
)
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promoted nav navigation navbar menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices banner alert popup modal overlay comment "
    "comments commentlist disqus respond replies reply share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search pagination pager widget skip toolbar copyright".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
_MAIN = frozenset("article main content post entry story".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[^A-Za-z]+")
_SPACE = re.compile(r"[\s ]+")


class Node:
    """An element, or a text (tag ``#``)."""

    __slots__ = ("tag", "label", "children", "text", "noise", "main", "number")

    def __init__(self, tag: str, label: str = "", text: str = "", noise: bool = False, main: bool = False):
        self.tag, self.label, self.text, self.noise, self.main, self.number = tag, label or tag, text, noise, main, -1
        self.children: list[Node] = []

    def __reduce__(self):
        return _node, (self.tag, self.label, self.children, self.noise, self.main, self.number, self.text)


def _node(tag, label, children, noise, main, number, text) -> Node:
    n = Node(tag, label, text, noise, main)
    n.children, n.number = children, number
    return n


def _element(tag: str, attributes: str) -> Node:
    noise, main, label = tag in _DROP, tag in ("article", "main"), tag
    if attributes:
        a = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attributes)}
        names = a.get("class", "") + " " + a.get("id", "")
        tokens = {w.lower() for w in _WORDS.split(names) if w}
        role = a.get("role", "").lower()
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        if tag not in ("html", "body", "article", "main"):
            noise = noise or bool(tokens & _NOISE) or role in _NOISE_ROLES or hidden
        main = main or role in ("main", "article") or bool(tokens & _MAIN)
        label = tag + "." + "-".join(sorted(tokens)[:3]) if tokens else tag
    return Node(tag, label, noise=noise, main=main and not noise)


def parse(page: str) -> Node:
    """The tree of a page, whatever its faults; ends that HTML lets one leave out are put in."""
    root = Node("html")
    stack, at = [root], 0

    def put(child: Node) -> None:
        """Appends to the innermost open element, or beyond DEPTH to the one there, under a stand-in for it."""
        if len(stack) > DEPTH:
            child.noise = child.noise or stack[-1].noise
            if child.tag == "#":
                outer = Node(stack[-1].tag, stack[-1].label, noise=stack[-1].noise)
                outer.children.append(child)
                child = outer
            stack[DEPTH - 1].children.append(child)
        else:
            stack[-1].children.append(child)

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                put(Node("#", text=text))
            continue
        tag, end = tag.lower(), m[1] or m[4]
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "button", "object", "table", "article", "section", "div", "body"):
                    break
        if tag in _CLOSES:
            closed, within = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[k].tag in within:
                    break
        node = _element(tag, m[3] or m[6] or "")
        put(node)
        if tag in _RAW:
            stop = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            inner, at = (page[at : stop.start()], stop.end()) if stop else (page[at:], len(page))
            if inner and tag in ("textarea", "title"):
                node.children.append(Node("#", text=inner))
        elif tag not in _VOID and not (tag in ("svg", "path") and (m[3] or m[6] or "").endswith("/")):
            stack.append(node)
    return root


def plain(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def children(node: Node) -> list[Node]:
    """The children that are compared: no blank texts."""
    return [c for c in node.children if c.tag != "#" or not c.text.isspace()]


class _Side:
    """Different shapes of one depth, to be scored against one shape all at once. ``below``: label and children's shapes by shape."""

    def __init__(self, shapes: list[int], below: list[tuple[str, tuple[int, ...]]]):
        self.shapes, self.below = np.array(shapes, np.int64), below
        self.labels = np.array([below[s][0] for s in shapes], object)
        self.sizes = np.array([len(below[s][1]) for s in shapes], np.int64)
        self.known: dict[int, np.ndarray] = {}
        self.cut: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.inner: _Side | None = None

    def parts(self, label: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """The shapes of a label that have children, in parts that are alike in the number of them, with the children's places."""
        made = self.cut.get(label)
        if made is None:
            made = self.cut[label] = []
            if self.inner is None:
                self.inner = _Side(sorted({c for s in self.shapes.tolist() for c in self.below[s][1]}), self.below)
            todo = np.flatnonzero((self.labels == label) & (self.sizes > 0))
            todo = todo[np.argsort(self.sizes[todo], kind="stable")]
            while len(todo):
                most = 2 * int(self.sizes[todo[0]])
                part = todo[: min(int(np.searchsorted(self.sizes[todo], most, "right")), max(1, SWEEP // most))]
                todo = todo[len(part) :]
                # A place beyond the last stands for no child, which scores nothing.
                at = np.full((int(self.sizes[part[-1]]), len(part)), len(self.inner.shapes))
                for k, n in enumerate(part.tolist()):
                    at[: self.sizes[n], k] = np.searchsorted(self.inner.shapes, self.below[self.shapes[n]][1])
                made.append((part, at))
        return made

    def scores(self, shape: int) -> np.ndarray:
        """Match.score of ``shape`` and each of the side's, by the same rule."""
        found = self.known.get(shape)
        if found is not None:
            return found
        label, kids = self.below[shape]
        found = (self.labels == label).astype(np.int64)
        for part, at in self.parts(label) if kids else []:
            row = np.zeros((len(at) + 1, len(part)), np.int64)
            for kid in kids:
                gain = np.append(self.inner.scores(kid), 0)[at]
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain), axis=0)
            found[part] += row[-1]
        if len(self.known) * len(found) > SWEEP:
            self.known.clear()
        self.known[shape] = found
        return found


class Match:
    """Simple tree matching of two trees: the greatest number of paired nodes, roots paired, order kept."""

    def __init__(self):
        self.scores: dict[tuple[int, int], int] = {}
        self.kids: dict[int, list[Node]] = {}
        self.shapes: dict[int, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.below: list[tuple[str, tuple[int, ...]]] = []
        self.long: dict[tuple[int, int], list[tuple[Node, Node]]] = {}

    def of(self, node: Node) -> list[Node]:
        found = self.kids.get(id(node))
        if found is None:
            found = self.kids[id(node)] = children(node)
        return found

    def children_paired(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The pairs of children with the greatest sum of scores; by one rule for lists of any length."""
        left, right = self.of(a), self.of(b)
        if len(left) * len(right) > CELLS:
            key = (id(a), id(b))
            found = self.long.get(key)
            if found is None:
                found = self.long[key] = self.long_paired(left, right)
            return found
        out: list[tuple[Node, Node]] = []
        rows = [[0] * (len(right) + 1)]
        for x in left:
            above, row = rows[-1], [0]
            for j, y in enumerate(right):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                if x.label == y.label:
                    s = above[j] + self.score(x, y)
                    if s > best:
                        best = s
                row.append(best)
            rows.append(row)
        i, j = len(left), len(right)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((left[i], right[j]))
        return out

    def shape(self, node: Node) -> int:
        """A number for the labels of a node and of all below it, on which scores depend and nothing else."""
        found = self.shapes.get(id(node))
        if found is None:
            key = (node.label, tuple([self.shape(c) for c in self.of(node)]))
            found = self.shapes[id(node)] = self.numbers.setdefault(key, len(self.numbers))
            if found == len(self.below):
                self.below.append(key)
        return found

    def long_paired(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """The pairs that the table of all cells would give, with one sweep for each row.

        The rows at every step, the root of their number, are kept; those between are made again on the way back.
        """
        shapes = [self.shape(y) for y in right]
        side = _Side(sorted(set(shapes)), self.below)
        at = np.searchsorted(side.shapes, shapes)

        def below(above: np.ndarray, x: Node) -> np.ndarray:
            row = np.zeros(len(right) + 1, np.int64)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + side.scores(self.shape(x))[at]), out=row[1:])
            return row

        step = isqrt(len(left))
        row = np.zeros(len(right) + 1, np.int64)
        kept = [row]
        for k, x in enumerate(left):
            row = below(row, x)
            if (k + 1) % step == 0:
                kept.append(row)
        out, i, j = [], len(left), len(right)
        for k in range((len(left) - 1) // step, -1, -1):
            first, rows = k * step, [kept[k]]
            for x in left[first:i]:
                rows.append(below(rows[-1], x))
            while i > first and j:
                here, above = rows[i - first], rows[i - first - 1]
                if here[j] == above[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((left[i], right[j]))
            if not j:
                break
        return out

    def score(self, a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        if not a.children or not b.children:
            return 1
        key = (id(a), id(b))
        found = self.scores.get(key)
        if found is None:
            found = self.scores[key] = 1 + sum(self.score(x, y) for x, y in self.children_paired(a, b))
        return found

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            if x.children and y.children:
                todo += self.children_paired(x, y)
        return out


_HOLDERS = frozenset("html body div section article main table tbody tr td center span header footer nav aside form fieldset details".split())


def number(frame: Node) -> Node:
    """``frame`` with its elements numbered in the order of the page, and without its texts."""
    k, todo = 0, [frame]
    while todo:
        n = todo.pop()
        if n.tag == "#":
            n.text = n.text[:1] if n.text.isspace() else "x"
        else:
            n.number, k = k, k + 1
            todo += reversed(n.children)
    return frame


def blocks(tree: Node) -> list[tuple[int, int, str]]:
    """(place, characters in links, text) of the blocks that aren't noise, in order; place is the nearest numbered element's."""
    out: list[tuple[int, int, str]] = []
    parts: list[str] = []
    place = linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = plain("".join(parts))
            if text:
                out.append((place, min(linked, len(text)), text))
            parts.clear()
            linked = 0

    def walk(node: Node, at: int, link: bool) -> None:
        nonlocal place, linked
        if node.noise:
            return
        if node.tag == "#":
            if not any(p and not p.isspace() for p in parts):
                place = at
            parts.append(node.text)
            if link:
                linked += len(plain(node.text))
            return
        at = node.number if node.number >= 0 else at
        block = node.tag in _BLOCK
        if block:
            close()
        link = link or node.tag == "a"
        for c in node.children:
            walk(c, at, link)
        if block:
            close()

    walk(tree, 0, False)
    close()
    return out


def verdict(frame: Node, figures: dict[int, tuple[int, int, int]]) -> list[bool]:
    """Whether blocks at each place of a numbered frame are content; figures: place to (pages, characters, those in links).

    The figures are of blocks that aren't constant. From the root down: a node's child that alone holds more than
    SMALL of its unlinked text, while what stands directly in the node (paragraphs, headings, lists) is small, is
    gone into; so is an element that is marked as the article and holds 0.3 of it. In the node so found, boxes before
    the first and after the last of the text that are small, and lists and boxes of links, are not content; nothing
    else is left out.
    """
    order: list[Node] = []
    todo = [frame]
    while todo:
        n = todo.pop()
        if n.tag != "#":
            order.append(n)
            todo += reversed(n.children)
    sums = {n.number: list(figures.get(n.number, (0, 0, 0))) for n in order}
    marked = set()
    for n in reversed(order):
        own = sums[n.number]
        for c in n.children:
            if c.tag != "#" and not c.noise:
                x = sums[c.number]
                own[0], own[1], own[2] = max(own[0], x[0]), own[1] + x[1], own[2] + x[2]
                if c.number in marked:
                    marked.add(n.number)
        if n.main and not n.noise:
            marked.add(n.number)
    worth = lambda n: sums[n.number][1] - sums[n.number][2]
    links = lambda n: 2 * sums[n.number][2] >= sums[n.number][1] > 0
    node = frame
    while True:
        boxes = [c for c in node.children if c.tag in _HOLDERS and not c.noise]
        big = [c for c in boxes if worth(c) > SMALL * worth(node) and not links(c)]
        article = [c for c in big if c.number in marked]
        direct = worth(node) - sum(map(worth, boxes))
        if article and 10 * sum(map(worth, article)) >= 3 * worth(node) and not (node.main and node.tag == "article"):
            into = article
        else:
            into = big if direct <= SMALL * worth(node) and not node.main else []
        if len(into) != 1:
            break
        node = into[0]
    shown = [k for k, c in enumerate(node.children) if c in big or c.tag != "#" and c not in boxes and not c.noise and worth(c) > 0]
    first, last = (shown[0], shown[-1]) if shown else (0, len(node.children))
    if shown and figures.get(node.number, (0, 0, 0))[1]:
        first, last = 0, len(node.children)  # text without an element of its own may stand anywhere in it
    keep = [False] * len(order)
    todo = [node]
    while todo:
        n = todo.pop()
        keep[n.number] = True
        for k, c in enumerate(n.children):
            if c.tag == "#" or c.noise:
                continue
            outside = n is node and c in boxes and c not in big and not first <= k <= last
            if outside or n is node and (c in boxes or c.tag in ("ul", "ol")) and links(c):
                continue
            todo.append(c)
    return keep


def figures_of(found: list[tuple[int, int, str]]) -> dict[int, tuple[int, int, int]]:
    """The figures of one page's blocks by place."""
    sums: dict[int, tuple[int, int, int]] = {}
    for place, linked, text in found:
        _, n, a = sums.get(place, (1, 0, 0))
        sums[place] = (1, n + len(text), a + linked)
    return sums


def analysed(page: str | None, frame: Node | None) -> list[tuple[int, int, bool, str]]:
    """(place in the frame, characters in links, content by the page's own tree, text) of each block of a page.

    Empty without a page; all places are 0 without a frame.
    """
    if not page:
        return []
    tree = parse(page)
    todo, above = [(tree, 0)], []
    while todo:
        n, parent = todo.pop()
        if n.tag != "#":
            n.number = len(above)
            above.append(parent)
            todo += [(c, n.number) for c in reversed(n.children)]
    found = blocks(tree)
    keep = verdict(tree, figures_of(found))
    at = [-1] * len(above)
    if frame is not None:
        for ours, theirs in Match().pairs(frame, tree):
            if theirs.tag != "#":
                at[theirs.number] = ours.number
    at[0] = 0
    for k, parent in enumerate(above):
        if at[k] < 0:
            at[k] = at[parent]
    return [(at[own], linked, keep[own], text) for own, linked, text in found]


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def frames(pages: DataFrame) -> DataFrame:
    """host, frame (pickled) of every host: the middle one in size of REFERENCES of its different pages, those with the least hashes.

    Only hashes are shuffled to choose them; the chosen keys go to the pages.
    """
    hashed = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("h"), "html")
    first = Window.partitionBy("host").orderBy("h")
    keys = hashed.select("host", "h").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= REFERENCES)
    keys = written(keys.select("host", "h"), "frame-keys")
    few = keys.count() <= BROADCAST_KEYS
    refs = hashed.join(F.broadcast(keys) if few else keys, ["host", "h"], "left_semi")

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trees = sorted((parse(p) for p in sorted(set(table.column("html").to_pylist()))), key=_size)
        return pa.table({"host": [key[0].as_py()], "frame": [pickle.dumps(number(trees[len(trees) // 2]), 5)]})

    # Copies of a chosen page are left out before the shuffle, task by task.
    refs = refs.groupBy("host", "h").agg(F.first("html").alias("html"))
    return written(refs.select("host", "html").groupBy("host").applyInArrow(one, "host string, frame binary"), "frames")


def _size(tree: Node) -> int:
    n, todo = 0, [tree]
    while todo:
        x = todo.pop()
        n += 1
        todo += x.children
    return n


class _Kept:
    """The last frames that a worker unpickled."""

    def __init__(self):
        self.by: dict[bytes, Node] = {}

    def get(self, packed: bytes | None) -> Node | None:
        if packed is None:
            return None
        found = self.by.get(packed)
        if found is None:
            if len(self.by) > 500:
                self.by.clear()
            found = self.by[packed] = pickle.loads(packed)
        return found


_BLOCKS = "array<struct<place: int, linked: int, own: boolean, text: string>>"
_BLOCKS_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("linked", pa.int32()), ("own", pa.bool_()), ("text", pa.string())]))


def _as_arrow(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("place", "linked", "own", "text"), b, strict=True)) for b in row] for row in rows], _BLOCKS_ARROW)


def aligned(pages: DataFrame, made: DataFrame) -> DataFrame:
    """page_id, url, host, blocks of every page, each aligned with the frame of its host."""
    spark = pages.sparkSession
    size, hosts = made.agg(F.coalesce(F.sum(F.length("frame") + F.length("host")), F.lit(0)), F.count("*")).first()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    if size <= BROADCAST_BYTES and hosts <= 1_000_000:
        sent = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in made.collect()})

        @F.arrow_udf(_BLOCKS)
        def found(html: pa.Array, host: pa.Array) -> pa.Array:
            of = sent.value
            return _as_arrow([analysed(p, _KEPT.get(of.get(h))) for p, h in zip(html.to_pylist(), host.to_pylist(), strict=True)])

        return rows.select("page_id", "url", "host", found("html", "host").alias("blocks"))

    # Pages of a host are dealt to so many salts that none gets many; each meets one copy of the frame.
    salts = rows.groupBy("host").count().select("host", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    dealt = rows.join(salts, "host").withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.col("salts")).cast("int"))
    copies = made.join(salts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "frame")

    def apply(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        frame = pickle.loads(right.column("frame")[0].as_py()) if right.num_rows else None
        return left.select(["page_id", "url", "host"]).append_column("blocks", _as_arrow([analysed(p.as_py(), frame) for p in left.column("html")]))

    both = dealt.select("host", "salt", "page_id", "url", "html").groupBy("host", "salt").cogroup(copies.groupBy("host", "salt"))
    return both.applyInArrow(apply, f"page_id long, url string, host string, blocks {_BLOCKS}")


_KEPT = _Kept()


def wrappers(found: DataFrame, made: DataFrame) -> DataFrame:
    """host, keep (by place: is it content?), constant (hashes of place and text) of hosts with CONSTANT_IN different pages.

    ``found`` is what aligned() gives. Pages whose blocks have the same texts count once. Counts cover all pages.
    """
    each = found.select("host", F.transform("blocks", lambda b: F.struct(b["place"].alias("place"), F.length(b["text"]).alias("n"), b["linked"].alias("linked"), _at(b).alias("h"))).alias("bs"))
    pages = each.where(F.size("bs") > 0).groupBy("host", F.xxhash64(F.transform("bs", lambda b: b["h"])).alias("page")).agg(F.first("bs").alias("bs"))
    pages = written(pages, "different-pages")
    n = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= CONSTANT_IN)
    # The figures of a page by place and text, so a text counts once a page.
    split = pages.select("host", "page", F.explode("bs").alias("b")).select("host", "page", "b.*")
    texts = split.groupBy("host", "place", "h", "page").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    texts = texts.groupBy("host", "place", "h").agg(F.count("*").alias("held"), F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    texts = written(texts, "template-counts")
    at = split.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count("*").alias("at"))
    often = texts.where(F.col("held") >= CONSTANT_IN).join(at, ["host", "place"]).where(F.col("held") >= CONSTANT_SHARE * F.col("at"))
    constant = written(often.select("host", "place", "h"), "constant")
    rest = texts.join(constant, ["host", "place", "h"], "left_anti").groupBy("host", "place").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    # A frame has as many places as one page has elements, and no more constants than its pages share.
    figures = rest.join(at, ["host", "place"]).groupBy("host").agg(F.collect_list(F.struct("place", "at", "n", "linked")).alias("figures"))

    @F.arrow_udf("array<boolean>")
    def judge(frame: pa.Array, figures: pa.Array) -> pa.Array:
        sums = [{f["place"]: (f["at"], f["n"], f["linked"]) for f in fs or []} for fs in figures.to_pylist()]
        return pa.array([verdict(pickle.loads(f), s) for f, s in zip(frame.to_pylist(), sums, strict=True)], pa.list_(pa.bool_()))

    kept = made.join(n, "host", "left_semi").join(figures, "host", "left").select("host", judge("frame", "figures").alias("keep"))
    same = constant.groupBy("host").agg(F.collect_list("h").alias("constant"))
    return written(kept.join(same, "host", "left"), "wrappers")


def _at(b: Column) -> Column:
    return F.xxhash64(b["place"], b["text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, by_wrapper (whether the host's wrapper told it) of every row of ``pages``.

    Null and empty html gives the empty text. Rows without an address count as one host. Repeated rows get
    equal texts; an empty table stays empty.
    """
    short_batches(pages.sparkSession)
    made = frames(pages)
    found = written(aligned(pages, made), "aligned", compression="zstd")
    wrapper = wrappers(found, made)
    size, hosts = wrapper.agg(F.coalesce(F.sum(F.size("keep") + 8 * F.greatest(F.size("constant"), F.lit(0)) + 64), F.lit(0)), F.count("*")).first()
    rows = found.join(F.broadcast(wrapper) if size <= BROADCAST_BYTES else wrapper, "host", "left")
    texts = lambda kept: F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    told = F.filter("blocks", lambda b: F.get(F.col("keep"), b["place"]) & ~F.coalesce(F.array_contains("constant", _at(b)), F.lit(False)))
    alone = F.filter("blocks", lambda b: b["own"])
    by = F.coalesce(F.size(told) > 0, F.lit(False))
    return rows.select("page_id", "url", F.when(by, texts(told)).otherwise(texts(alone)).alias("text"), by.alias("by_wrapper"))


def op3_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page, and by_wrapper."""
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_wrapper")
