"""HTML as a small tree of blocks, and the alignment of two such trees.

A page becomes its blocks of text, each with the slot it stands in, and a shape: the tree of its block
elements, in which siblings of equal shape are one node.  So a list is one item and an article one paragraph,
and pages of one template have few shapes, whatever their length.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
from dataclasses import dataclass, field

import numpy as np

# fixed values: elements and words of HTML and of its common use
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes svg object canvas audio video textarea select datalist button map title".split()
)
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th
    thead tr ul""".split()
)
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
SCOPE = frozenset("td th caption table".split())
TEMPLATE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
TEMPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
TEMPLATE_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice
    notices notification notifications overlay pager pagination paywall popup promo promos promotion promotions recommended related
    replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar
    widget widgets""".split()
)
PAGE_WORDS = frozenset(["header"])  # a header within the article is part of it
READER_WORDS = frozenset("comment comments disqus replies reply respond".split())

MOST_DEPTH = 200  # deeper elements are siblings

_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))                                     # comment
    |</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
    |<(?P<start>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)                                              # declaration and broken markup
    """,
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NO_DISPLAY = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

TEXT = "#"


@dataclass(slots=True)
class Node:
    """A block element; ``mark`` is ``t`` for what template markup says, ``a`` and ``m`` for article and main."""

    tag: str
    mark: str = ""
    names: str = ""
    unseen: bool = False
    inner: bool = False  # within article or main
    children: list[Node | Leaf] = field(default_factory=list)


@dataclass(slots=True)
class Leaf:
    """A block of text, with the characters of it that stand in links."""

    text: str
    linked: int


def _words(value: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub(" ", value).lower())


def _element(tag: str, rest: str, inner: bool) -> Node:
    attributes = {}
    if rest and not rest.isspace():
        for name, *values in _ATTRIBUTE.findall(rest):
            attributes.setdefault(name.lower(), html.unescape("".join(values)))
    names = _words(attributes.get("class", "")) + _words(attributes.get("id", ""))
    role = attributes.get("role", "").strip().lower()
    node = Node(tag, names=" ".join(sorted(set(names))), inner=inner)
    node.unseen = tag in UNSEEN or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    node.unseen = node.unseen or bool(_NO_DISPLAY.search(attributes.get("style", "")))
    if tag in ("html", "body"):
        node.unseen = False
    elif READER_WORDS.intersection(names) or tag in TEMPLATE_TAGS or role in TEMPLATE_ROLES:
        node.mark = "t"
    elif tag == "article" or role == "article":
        node.mark = "a"
    elif tag == "main" or role == "main":
        node.mark = "m"
    elif not inner and (tag == "header" or PAGE_WORDS.intersection(names)):
        node.mark = "w" if tag != "header" else "t"
    elif TEMPLATE_WORDS.intersection(names):
        node.mark = "w"
    return node


class _Builder:
    """Open elements and the block of text being read."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open: list[tuple[str, Node | None]] = []
        self.at = [self.root]  # open block elements
        self.parts: list[tuple[str, bool]] = []
        self.links = 0
        self.beyond: dict[str, int] = {}

    def boundary(self) -> None:
        if self.parts and not self.at[-1].unseen:
            text = " ".join(html.unescape("".join(p for p, _ in self.parts)).split())
            if text:
                linked = sum(len(" ".join(html.unescape(p).split())) for p, in_link in self.parts if in_link)
                self.at[-1].children.append(Leaf(text, min(linked, len(text))))
            self.parts = []

    def text(self, raw: str) -> None:
        if len(self.at) > 1 and self.at[-1].tag == "head" and not raw.isspace():
            self.close("head")
        if not self.at[-1].unseen:
            self.parts.append((raw, self.links > 0))

    def close(self, tag: str, within: tuple[str, ...] = ()) -> bool:
        """Close the innermost ``tag`` and all that is open in it, unless an element of ``within`` is met before."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                break
            if name in within or (name in SCOPE and tag not in SCOPE and tag not in ("tr", "tbody", "thead", "tfoot")):
                return False
            if self.open[k][1] is not None and tag not in BLOCK and tag not in UNSEEN:
                return False
        else:
            return False
        for name, node in self.open[k:]:
            if node is not None:
                self.boundary()
                self.at.pop()
            elif name == "a":
                self.links -= 1
        del self.open[k:]
        return True

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if len(self.at) > 1 and self.at[-1].tag == "head" and tag not in HEAD:
            self.close("head")
        if tag in CLOSED_BY:
            for other in CLOSED_BY[tag][0]:
                self.close(other, CLOSED_BY[tag][1])
        block = tag in BLOCK
        if block:
            if self.at[-1].tag == "p":
                self.close("p")
            self.boundary()
        if tag in VOID or tag in ("html", "body"):
            if tag == "img":
                self.text(" ")
            return
        node = _element(tag, rest, self.at[-1].inner)
        if not (block or node.unseen):
            if tag == "a":
                self.close("a")
                self.links += 1
            self.open.append((tag, None))
            return
        if len(self.at) >= MOST_DEPTH and not node.unseen:
            self.beyond[tag] = self.beyond.get(tag, 0) + 1
            return
        if block or node.tag == "head":
            self.boundary()
        elif tag not in RAW and tag != "template":
            self.text(" ")
        parent = self.at[-1]
        node.unseen = node.unseen or parent.unseen
        node.inner = parent.inner or node.mark in ("a", "m")
        if not node.unseen:
            parent.children.append(node)
        self.open.append((tag, node))
        self.at.append(node)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.boundary()
        if self.beyond.get(tag):
            self.beyond[tag] -= 1
        elif tag == "br":
            self.text(" ")
        elif tag not in ("html", "body"):
            self.close(tag)


def parsed(page: str) -> Node:
    """The tree of block elements of a page; broken markup is read leniently, no text of it is lost."""
    tree, at = _Builder(), 0
    for_raw: dict[str, re.Pattern] = {}
    while True:
        low = page.find("<", at)
        if low < 0:
            break
        found = _TAG.match(page, low)
        if found is None:  # a bare "<"
            tree.text(page[at : low + 1])
            at = low + 1
            continue
        if low > at:
            tree.text(page[at:low])
        at = found.end()
        if found["start"]:
            tag = found["start"].lower()
            tree.start(tag, found["rest"])
            if tag in RAW:
                end = for_raw.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I)).search(page, at)
                at = end.end() if end else len(page)
                tree.close(tag)
        elif found["end"]:
            tree.end(found["end"].lower())
    if at < len(page):
        tree.text(page[at:])
    tree.boundary()
    return tree.root


@dataclass(slots=True)
class Block:
    slot: int
    text: str
    linked: int


def _holds_article(node: Node) -> bool:
    return any(isinstance(c, Node) and (c.mark in ("a", "m") or _holds_article(c)) for c in node.children)


def _settle(node: Node) -> None:
    """Marks by words of a class count only where no article is inside."""
    if node.mark == "w":
        node.mark = "" if _holds_article(node) else "t"
    for c in node.children:
        if isinstance(c, Node):
            _settle(c)


Shape = list  # [label, names, kept, children]


def shaped(root: Node) -> tuple[Shape, list[Block]]:
    """The shape of a page and its blocks of text in order, each with the place of its slot in the shape.

    A node of the shape is ``[tag and mark, names, region, children]``; ``region`` tells what markup says of the
    text in it: ``t`` template, ``a`` within an article, ``m`` within main, else empty.
    """
    _settle(root)
    known: dict[tuple, int] = {}
    kinds: dict[int, int] = {}

    def kind(node: Node | Leaf) -> int:
        if isinstance(node, Leaf):
            return -1
        inside = tuple(dict.fromkeys(kind(c) for c in node.children))
        kinds[id(node)] = out = known.setdefault((node.tag, node.mark, node.names, inside), len(known))
        return out

    kind(root)
    slots: dict[int, int] = {}
    count = 0

    def folded(same: list[Node], region: str) -> Shape:
        nonlocal count
        count += 1
        node = same[0]
        if region != "t" and (node.mark == "t" or (node.mark and region != "a")):
            region = node.mark
        groups: dict[int, list] = {}
        for n in same:
            for c in n.children:
                groups.setdefault(-1 if isinstance(c, Leaf) else kinds[id(c)], []).append(c)
        children: list[Shape] = []
        for k, members in groups.items():
            if k == -1:
                for leaf in members:
                    slots[id(leaf)] = count
                children.append([TEXT, "", region, []])
                count += 1
            else:
                children.append(folded(members, region))
        return [node.tag + ("." + node.mark if node.mark else ""), node.names, region, children]

    shape = folded([root], "")
    blocks: list[Block] = []

    def read(node: Node) -> None:
        for c in node.children:
            if isinstance(c, Leaf):
                blocks.append(Block(slots[id(c)], c.text, c.linked))
            else:
                read(c)

    read(root)
    return shape, blocks


def regions(shape: Shape) -> list[tuple[str, str, str]]:
    """Region, label and parent's label of every node of a shape, in order."""
    out: list[tuple[str, str, str]] = []

    def walk(node: Shape, parent: str) -> None:
        out.append((node[2], node[0], parent))
        for c in node[3]:
            walk(c, node[0])

    walk(shape, "")
    return out


def _sized(shape: Shape) -> int:
    return 1 + sum(_sized(c) for c in shape[3])


MOST_CELLS = 1 << 18  # of one table of children held whole; of longer lists of children only some rows are
MOST_KEPT = 1 << 18  # weights that are remembered below long lists
SHORT = 256  # cells of a table that plain loops are faster for


class _Kinds:
    """Labels, names and what is below of siblings, each as a number."""

    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        self.label, self.names, self.below = np.array(rows, np.int64).reshape(-1, 3).T
        self.kinds, self.at = np.unique(self.below, return_inverse=True)


class _LongLists:
    """The same match for long lists of children, a row of the table at a time.

    The best of every prefix is kept for each ``step``-th child on the left; the way back works out the rows
    between two of those again.  So memory grows with one list and the square root of the other.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[object, int] = {}
        self.of: dict[int, int] = {}  # what is below a node, by the node
        self.lists: dict[int, list[tuple[int, int, int]]] = {}  # the children that this stands for
        self.known: dict[tuple[int, int], int] = {}

    def _number(self, key: object) -> int:
        return self.numbers.setdefault(key, len(self.numbers))

    def _below(self, node: Shape) -> int:
        if id(node) not in self.of:
            kinds = tuple(self._kind(c) for c in node[3])
            self.of[id(node)] = found = self._number(("below", kinds))
            self.lists[found] = list(kinds)
        return self.of[id(node)]

    def _kind(self, node: Shape) -> tuple[int, int, int]:
        return self._number(("label", node[0])), self._number(("names", node[1])), self._below(node)

    def _between(self, a: int, b: int) -> int:
        """Weight of the best match of two lists of children, by their numbers."""
        left, right = self.lists[a], self.lists[b]
        if not left or not right:
            return 0
        if (a, b) not in self.known:
            weight = self._of_short(left, right) if len(left) * len(right) <= SHORT else self._of_long(left, right)
            if len(self.known) >= MOST_KEPT:
                self.known.clear()
            self.known[a, b] = weight
        return self.known[a, b]

    def _of_short(self, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]]) -> int:
        best = [0] * (len(right) + 1)
        for label, names, below in left:
            before = best
            best = [0]
            for j, (other, called, under) in enumerate(right):
                most = max(before[j + 1], best[j])
                if label == other:
                    most = max(most, before[j] + 1 + (names == called) + self._between(below, under))
                best.append(most)
        return best[-1]

    def _of_long(self, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]]) -> int:
        one, other = _Kinds(left), _Kinds(right)
        best = np.zeros(len(right) + 1, np.int64)
        for i in range(len(left)):
            best = self._next(best, one, i, other)
        return int(best[-1])

    def _weights(self, left: _Kinds, i: int, right: _Kinds) -> np.ndarray:
        """Weights of the i-th child on the left with all on the right; 0 for another label."""
        same = right.label == left.label[i]
        wanted = np.zeros(len(right.kinds), bool)
        wanted[right.at[same]] = True
        below = np.zeros(len(right.kinds), np.int64)
        for k in np.flatnonzero(wanted):
            below[k] = self._between(int(left.below[i]), int(right.kinds[k]))
        return np.where(same, 1 + (right.names == left.names[i]) + below[right.at], 0)

    def _next(self, best: np.ndarray, left: _Kinds, i: int, right: _Kinds) -> np.ndarray:
        """The row of the table after the i-th child on the left."""
        weights = self._weights(left, i, right)
        out = best.copy()
        out[1:] = np.maximum(out[1:], np.where(weights > 0, best[:-1] + weights, 0))
        return np.maximum.accumulate(out)

    def matched(self, left: list[Shape], right: list[Shape]) -> tuple[int, list[tuple[int, int]]]:
        rights = [self._kind(n) for n in right]
        one, other = _Kinds([self._kind(n) for n in left]), _Kinds(rights)
        step = math.isqrt(len(left) - 1) + 1
        best = np.zeros(len(right) + 1, np.int64)
        held = []
        for i in range(len(left)):
            if i % step == 0:
                held.append(best)
            best = self._next(best, one, i, other)
        pairs, j = [], len(right)
        for first in range(len(held) - 1, -1, -1):
            rows, other = [held.pop()[: j + 1]], _Kinds(rights[:j])  # the way goes on to the left
            for i in range(first * step, min(len(left), (first + 1) * step)):
                rows.append(self._next(rows[-1], one, i, other))
            i = len(rows) - 1
            while i and j:  # back along the best way
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((first * step + i, j))
        return int(best[-1]), pairs[::-1]


class Alignment:
    """Simple tree matching: the largest order-keeping match of two trees, level by level."""

    def __init__(self, wrapper: Shape) -> None:
        self.wrapper = wrapper
        self.weights: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.long = _LongLists()

    def _pairs(self, a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
        """Weight of the best match below two matched nodes, and its pairs of children."""
        key = (id(a), id(b))
        if key not in self.weights:
            self.weights[key] = self._matched(a[3], b[3])
        return self.weights[key]

    def _weight(self, a: Shape, b: Shape) -> int:
        if a[0] != b[0]:
            return 0
        return 1 + (a[1] == b[1]) + self._pairs(a, b)[0]

    def _matched(self, left: list[Shape], right: list[Shape]) -> tuple[int, list[tuple[int, int]]]:
        if len(left) * len(right) > MOST_CELLS:
            return self.long.matched(left, right)
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                w = self._weight(a, b)
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
        pairs, i, j = [], len(left), len(right)
        while i and j:  # back along the best way
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return best[-1][-1], pairs[::-1]

    def places(self, shape: Shape) -> list[int]:
        """For every node of ``shape`` its place in the wrapper; nodes without one get a place named after their path."""
        self.weights.clear()
        self.long.clear()
        out: list[int] = []

        def named(above: int, node: Shape) -> int:
            name = json.dumps([above, node[0], node[1]]).encode()
            return -1 - int.from_bytes(hashlib.blake2b(name, digest_size=7).digest(), "big")

        def walk(a: Shape, b: Shape | None, place: int) -> None:
            out.append(place)
            if b is None:
                for c in a[3]:
                    walk(c, None, named(place, c))
                return
            matched = dict(self._pairs(a, b)[1])
            starts, at = [], place + 1
            for c in b[3]:
                starts.append(at)
                at += _sized(c)
            for i, c in enumerate(a[3]):
                j = matched.get(i)
                if j is None:
                    walk(c, None, named(place, c))
                else:
                    walk(c, b[3][j], starts[j])

        walk(shape, self.wrapper, 0)
        return out
