"""Main text of web pages by wrapper induction.

Pages become trees of block elements. The trees of each host are aligned by
simple tree matching and merged into a template, whose nodes gather how much text they
have and which texts they have on every page. Those constant texts are template; of the varying
slots, the one that holds the article is the content. The host's wrapper is then
aligned with each page to take its content.

Elements nested deeper than ``DEEPEST`` are laid flat in their ancestor, as browsers do, so
that no page exhausts the stack; none of their text is lost.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .urls import split_url

# HTML element kinds, fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("button script style textarea title noscript iframe template svg select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("caption dd dt head html body legend li summary tbody tfoot thead tr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tbody", "thead", "tfoot", "tr"}, "tfoot": {"tbody", "thead", "tr"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "body": {"html"}}

#: What is never main text: elements, roles, and words in class or id.
OUT_TAGS = frozenset("aside dialog footer form head menu nav search".split())
OUT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus gdpr login "
    "menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promotion recommended related replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
#: Articles that are none.
OUT_ARTICLES = frozenset("ad ads advert adverts advertisement comment comments promo promotion related reply replies sponsored teaser".split())
#: The same, but not within an article, where they hold its title.
OUT_WORDS_AROUND = frozenset("footer header masthead topbar".split())

DEEPEST = 200
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
#: The same without heed to quotation marks, from a tag on that never ends with them.
_UNQUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "label", "out", "kids")

    def __init__(self, tag: str, label: str, out: bool):
        self.tag, self.label, self.out, self.kids = tag, label, out, []  # kids: nodes and texts in page order


def _open(tag: str, attrs: str, within: bool) -> Node:
    """The node of a start tag; within: in an article."""
    name, words, role = "", set(), ""
    for key, a, b, c in _ATTR.findall(attrs) if "=" in attrs else ():
        value = a or b or c
        if key.lower() == "role":
            role = value.lower()
        else:
            words.update(w.lower() for w in _WORDS.findall(value))
            if key.lower() == "class" and value.split():
                name = re.sub(r"\d{3,}", "", value.split()[0])  # numbers of items
    out = tag in OUT_TAGS or role in OUT_ROLES or bool(words & OUT_WORDS) or (not within and (tag == "header" or bool(words & OUT_WORDS_AROUND)))
    if tag in ("html", "body", "main"):
        out = False
    elif tag == "article":
        out = bool(words & OUT_ARTICLES)
    return Node(tag, f"{tag}.{name}" if name else tag, out)


def tree(page: str) -> Node:
    """The block elements of a page, with the text between them; inline elements leave only their text. Time is linear in the page."""
    root = Node("#", "#", False)
    stack, opened, articles = [root], Counter(), 0
    at, done, token, endless = 0, 0, _TOKEN, set()  # text from done on is not yet in the tree

    def pop_to(i: int) -> None:
        nonlocal articles
        while len(stack) > i:
            node = stack.pop()
            opened[node.tag] -= 1
            articles -= node.tag == "article"
            if node.label is None:  # laid flat: its end still ends a block
                node.kids.append(None)

    while (at := page.find("<", at)) >= 0:
        m = token.match(page, at)
        if m is None and token is _TOKEN and page[at + 1 : at + 2].isalpha():
            token = _UNQUOTED
            m = token.match(page, at)
        if m is None:
            at += 1
            continue
        if at > done:
            stack[-1].kids.append(page[done:at])
        at = done = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/") and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                if end is None:
                    endless.add(tag)
                at = done = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag not in BLOCK:
            if tag in ("br", "img", "td", "th", "input"):
                stack[-1].kids.append(" ")
            continue
        if m[1]:
            if opened[tag]:
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            else:
                stack[-1].kids.append(None)  # still ends a block
            continue
        if tag in ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in ("table", "li", "blockquote", "div", "section", "article", "body"):
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSED_BY and any(opened[x] for x in CLOSED_BY[tag]) else ():
            if stack[i].tag in CLOSED_BY[tag]:
                pop_to(i)
                break
            if stack[i].tag in SCOPE[tag]:
                break
        node = _open(tag, m[3], articles > 0)
        if len(stack) > DEEPEST and not node.out:
            node.label, node.kids = None, stack[-1].kids
            node.kids.append(None)
        else:
            stack[-1].kids.append(node)
        if tag != "hr" and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
            articles += tag == "article"
    if done < len(page):
        stack[-1].kids.append(page[done:])
    return root


class Shape:
    """A page's or template's node without its texts; siblings in a row with one label are one node.

    Of a template's node: pages that have it, the least and greatest hash of those whole pages' texts, elements and
    characters found there, and ``common``, the texts (their hash and length) that it has on every one of those pages.
    """

    __slots__ = ("label", "out", "nodes", "kids", "pages", "low", "high", "found", "chars", "common", "flag", "kind")

    def __init__(self, label: str, out: bool):
        self.label, self.out, self.nodes, self.kids = label, out, [], []
        self.pages, self.low, self.high, self.found, self.chars, self.common, self.flag = 0, None, None, 0, 0, None, 0

    def preorder(self) -> list[Shape]:
        got, todo = [], [self]
        while todo:
            s = todo.pop()
            got.append(s)
            todo.extend(reversed(s.kids))
        return got


def shape(nodes: list[Node]) -> Shape:
    """The shape of nodes in a row with one label."""
    s = Shape(nodes[0].label, nodes[0].out)
    s.nodes = nodes
    runs: list[list[Node]] = []
    for n in nodes:
        for k in n.kids:
            if k.__class__ is Node:
                if runs and runs[-1][0].label == k.label:
                    runs[-1].append(k)
                else:
                    runs.append([k])
    if len(nodes) > 1 and runs:  # what several nodes hold is one pattern
        by: dict[str, list[Node]] = {}
        for r in runs:
            by.setdefault(r[0].label, []).extend(r)
        runs = list(by.values())
    s.kids = [shape(r) for r in runs]
    return s


def skeleton(s: Shape) -> str:
    return f"{s.label}({''.join(map(skeleton, s.kids))})" if s.kids else s.label + ","


def own_text(node: Node) -> str:
    """What stands in the element itself, not in block elements within it."""
    return " ".join("".join(k for k in node.kids if k.__class__ is str).split())


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


class Sizes:
    """Sizes of the largest matches of trees, kept by their kinds: trees with the same labels throughout are of one kind.

    Trees are named before they are matched; names hold until a tree changes.
    """

    #: Sizes that are kept, and the longest row that is summed without arrays, which are slower there: neither changes a result.
    KNOWN, PLAIN = 1 << 18, 100

    def __init__(self):
        self.kinds: dict[tuple, int] = {}
        self.counts: list[int] = []  # nodes of a tree of the kind
        self.known: dict[tuple[int, int], int] = {}

    def name(self, s: Shape) -> int:
        key = (s.label, *map(self.name, s.kids))
        s.kind = self.kinds.setdefault(key, len(self.kinds))
        if s.kind == len(self.counts):
            self.counts.append(1 + sum(self.counts[k] for k in key[1:]))
        return s.kind

    def of(self, x: Shape, y: Shape) -> int:
        """Of two trees with one label."""
        if x.kind == y.kind:
            return self.counts[x.kind]
        if not x.kids or not y.kids:
            return 1
        key = x.kind, y.kind
        size = self.known.get(key)
        if size is None:
            size = 1 + self.of_rows(x.kids, y.kids)
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            self.known[key] = size
        return size

    def of_rows(self, a: list[Shape], b: list[Shape]) -> int:
        # equal trees at the ends of both rows are in a largest match
        first, n, m, size = 0, len(a), len(b), 0
        while n and m and a[n - 1].kind == b[m - 1].kind:
            n, m = n - 1, m - 1
            size += self.counts[a[n].kind]
        while first < n and first < m and a[first].kind == b[first].kind:
            size += self.counts[a[first].kind]
            first += 1
        a, b = a[first:n], b[first:m]
        if not a or not b:
            return size
        if len(b) > self.PLAIN:
            t = Table(a, b, self)
            row = t.start()
            for i in range(len(t.a)):
                row = t.after(i, row)
            return size + int(row[-1])
        labels, row = [y.label for y in b], [0] * len(b)
        for x in a:
            if x.label not in labels:
                continue
            left = corner = 0
            for j, label in enumerate(labels):
                above = row[j]
                best = max(above, left)
                if label == x.label:
                    best = max(best, corner + self.of(x, b[j]))
                row[j] = left = best
                corner = above
        return size + row[-1]


class Table:
    """The matching of two rows of trees by dynamic programming: rows of the table for the trees of ``a``, columns for those of ``b``.

    Every combination is weighed, whatever the length. ``HELD`` bounds the cells in memory, not what is matched:
    beyond it some rows are kept and those between are made again.
    """

    HELD, KEPT = 1 << 22, 16

    def __init__(self, a: list[Shape], b: list[Shape], sizes: Sizes):
        self.b, self.sizes = b, sizes
        by: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            by.setdefault(y.label, []).append(j)
        self.at = [i for i, x in enumerate(a) if x.label in by]  # others match nothing
        self.a = [a[i] for i in self.at]
        self.places: dict[str, tuple[np.ndarray, list[Shape], np.ndarray]] = {}
        for label in {x.label for x in self.a}:  # columns of a label, a tree of each kind there, and each column's among these
            kinds = {b[j].kind: b[j] for j in by[label]}
            nth = {k: i for i, k in enumerate(kinds)}
            self.places[label] = np.array(by[label]), list(kinds.values()), np.array([nth[b[j].kind] for j in by[label]])

    def start(self) -> np.ndarray:
        return np.zeros(len(self.b) + 1, np.int32)

    def after(self, i: int, row: np.ndarray) -> np.ndarray:
        """The row of the i-th tree, from the one before; as many columns as that has."""
        x = self.a[i]
        cols, trees, nth = self.places[x.label]
        cols = cols[: np.searchsorted(cols, len(row) - 1)]
        w = np.fromiter((self.sizes.of(x, y) for y in trees), np.int32, len(trees))
        with_x = row[cols] + (w[nth[: len(cols)]] if len(w) > 1 else w)
        cols, out = cols + 1, row.copy()
        out[cols] = np.maximum(row[cols], with_x)
        return np.maximum.accumulate(out, out=out)

    def pairs(self) -> list[tuple[int, int]]:
        """The pairs of the largest match, last first. Of equal ones that which has the last pair, then leaves out trees of ``a`` rather than of ``b``."""
        found: list[tuple[int, int]] = []
        self._back(0, len(self.a), self.start(), found)
        return found

    def _back(self, low: int, high: int, row: np.ndarray, found: list[tuple[int, int]]) -> int:
        """Go back from the last column of row ``high`` to row ``low``, which is given, and return the column there."""
        j = len(row) - 1
        if high - low > 1 and (high - low) * len(row) > self.HELD:
            step = -(-(high - low) // self.KEPT)
            kept = []
            for i in range(low, high):
                if (i - low) % step == 0:
                    kept.append(row)
                row = self.after(i, row)
            for k in range(len(kept) - 1, -1, -1):
                j = self._back(low + k * step, min(high, low + (k + 1) * step), kept.pop()[: j + 1], found)
            return j
        rows = [row]
        for i in range(low, high):
            rows.append(self.after(i, rows[-1]))
        i = high
        while i > low and j:
            here, above, x, y = rows[i - low], rows[i - low - 1], self.a[i - 1], self.b[j - 1]
            if x.label == y.label and here[j] == above[j - 1] + self.sizes.of(x, y):
                i, j = i - 1, j - 1
                found.append((self.at[i], j))
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
        return j


def matched(a: list[Shape], b: list[Shape], sizes: Sizes | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the largest match of two rows of trees that keeps order and depth, and the pairs of its top.

    sizes: has named the trees.
    """
    if not a or not b:
        return 0, []
    if sizes is None:
        sizes = Sizes()
        for s in (*a, *b):
            sizes.name(s)
    n, m, pairs = len(a), len(b), []
    while n and m and a[n - 1].kind == b[m - 1].kind:  # equal trees at the end are the last pair of a largest match
        n, m = n - 1, m - 1
        pairs.append((n, m))
    if n and m:
        pairs += Table(a[:n], b[:m], sizes).pairs()
    return sum(sizes.of(a[i], b[j]) for i, j in pairs), pairs[::-1]


def aligned(template: Shape, page: Shape, grow: bool) -> list[Shape | None]:
    """The template's node of each node of the page, in preorder; what it lacks it gets (grow) or is None."""
    sizes, put = Sizes(), []
    sizes.name(template)
    sizes.name(page)
    _absorb(template, page, put, grow, sizes)
    return put


def _absorb(template: Shape, page: Shape, put: list[Shape | None], grow: bool, sizes: Sizes) -> None:
    """Align ``page`` with ``template`` and append to ``put`` the template node of each page node, in preorder."""
    put.append(template)
    at = 0
    fits_ = dict((j, i) for i, j in matched(template.kids, page.kids, sizes)[1])
    shift = 0
    for j, kid in enumerate(page.kids):
        if j in fits_:
            at = fits_[j] + shift + 1
            _absorb(template.kids[at - 1], kid, put, grow, sizes)
        elif grow:
            new = Shape(kid.label, kid.out)
            template.kids.insert(at, new)
            at, shift = at + 1, shift + 1
            _absorb(new, kid, put, grow, sizes)
        else:
            put.extend([None] * len(kid.preorder()))


class Host:
    """The template of a host's pages.

    A template of over ``most`` nodes sheds those on under a twentieth of its pages, so that it is bounded
    by the size of pages, not by their number. A node on at least 55 % of all pages is never counted at under 50 %.
    """

    MOST = 1024

    def __init__(self):
        self.template, self.most = Shape("#", False), self.MOST

    def align(self, s: Shape) -> list[Shape]:
        return aligned(self.template, s, True)

    @staticmethod
    def _count(t: Shape, pages: int, low: int, high: int, found: int, chars: int, common: dict[int, int]) -> None:
        fresh = not t.pages
        t.low, t.high = (low, high) if fresh else (min(t.low, low), max(t.high, high))
        t.common = common if fresh else {h: n for h, n in t.common.items() if h in common}
        t.pages, t.found, t.chars = t.pages + pages, t.found + found, t.chars + chars

    def add(self, s: Shape, put: list[Shape]) -> None:
        """Count an aligned page."""
        own = [[t for n in x.nodes if (t := own_text(n))] for x in s.preorder()]
        texts = [{_hash(t): len(t) for t in ts} for ts in own]
        whole = _hash("\n\n".join(t for ts in own for t in ts))
        for t, x, ts, common in zip(put, s.preorder(), own, texts, strict=True):
            self._count(t, 1, whole, whole, len(x.nodes), sum(map(len, ts)), common)

    def merge(self, other: Host) -> None:
        for t, x in zip(self.align(other.template), other.template.preorder(), strict=True):
            if x.pages:
                self._count(t, x.pages, x.low, x.high, x.found, x.chars, x.common)
        self.shed()

    def shed(self) -> bool:
        """Whether the template had grown too large and lost its rare nodes."""
        every = self.template.preorder()
        if len(every) <= self.most:
            return False
        for s in every:
            s.kids = [k for k in s.kids if 20 * k.pages >= self.template.pages]
        self.most = max(self.MOST, 2 * len(self.template.preorder()))
        return True

    def dump(self) -> str:
        return json.dumps(_pack(self.template))

    @classmethod
    def read(cls, x: str) -> Host:
        h = cls()
        h.template = _unpack(json.loads(x))
        return h


class Learner:
    """The templates of the hosts that a task has met. Alignments are kept for pages of the same skeleton."""

    def __init__(self):
        self.hosts: dict[str, Host] = {}
        self.known: dict[tuple[str, str], list[Shape]] = {}

    def add(self, host: str, page: str) -> None:
        s = shape([tree(page)])
        at = self.hosts.setdefault(host, Host())
        key = host, skeleton(s)
        put = self.known.get(key)
        if put is None:
            put = at.align(s)
            if len(self.known) > 5000:
                self.known.clear()
            self.known[key] = put
            at.add(s, put)
            if at.shed():
                self.known.clear()
        else:
            at.add(s, put)

    def dump(self) -> Iterator[tuple[str, str]]:
        for host, at in self.hosts.items():
            yield host, at.dump()


def _pack(s: Shape) -> list:
    return [s.label, int(s.out), s.pages, s.low, s.high, s.found, s.chars, list((s.common or {}).items()), [_pack(k) for k in s.kids]]


def _unpack(x: list) -> Shape:
    s = Shape(x[0], bool(x[1]))
    s.pages, s.low, s.high, s.found, s.chars, s.common, s.kids = *x[2:7], dict(map(tuple, x[7])), [_unpack(k) for k in x[8]]
    return s


CONTENT = 1


def _tag(s: Shape) -> str:
    return s.label.split(".")[0]


def induce(host: Host) -> Shape:
    """The wrapper of a host: its template with the slot of the content flagged, and its constant texts in ``common``.

    A text is constant where the node that has it stands on half of the host's pages at least, and
    has it on all of those, while their other texts differ. The content is the article or main element with the most
    varying text, else the deepest node that holds most of it.
    """
    template = host.template
    for s in template.preorder():
        if s.low == s.high or 2 * s.pages < template.pages:
            s.common = {}

    def weigh(s: Shape, out: bool) -> int:
        out = out or s.out
        mass[id(s)] = 0 if out else max(0, s.chars - s.pages * sum(s.common.values()))
        for k in s.kids:
            mass[id(s)] += weigh(k, out)
        return mass[id(s)]

    mass: dict[int, int] = {}
    weigh(template, False)
    named = [s for s in template.preorder() if _tag(s) in ("article", "main") and mass[id(s)]]
    if named:
        best = max(named, key=lambda s: (_tag(s) == "article", mass[id(s)]))
        if _tag(best) == "article" and (mains := [s for s in named if _tag(s) == "main"]) and mass[id(best)] < 0.3 * max(mass[id(s)] for s in mains):
            best = max(mains, key=lambda s: mass[id(s)])
    else:
        best = template
        while heavy := [k for k in best.kids if mass[id(k)] > 0.7 * mass[id(best)] and k.found <= 1.5 * max(k.pages, 1)]:
            best = max(heavy, key=lambda s: mass[id(s)])
    best.flag = CONTENT
    return template


def _blocks(node: Node, constant: set[int], blocks: list[list[str]]) -> None:
    blocks.append([])
    for k in node.kids:
        if k.__class__ is str:
            blocks[-1].append(k)
        elif k is None:
            blocks.append([])
        elif not k.out and not (constant and _is_template(k, constant)):
            _blocks(k, _NONE, blocks)
            blocks.append([])


_NONE: set[int] = set()


def _is_template(node: Node, constant: set[int]) -> bool:
    """Whether a node says something, and nothing but constant texts."""
    says, todo = False, [node]
    while todo:
        n = todo.pop()
        if id(n) in constant:
            says = True
        elif own_text(n):
            return False
        todo += [k for k in n.kids if k.__class__ is Node]
    return says


def text_of(nodes: list[Node], constant: set[int] = _NONE) -> str:
    """The blocks below ``nodes``, but for template elements among them: references decoded, white space as one space, trimmed, joined by an empty line."""
    blocks: list[list[str]] = []
    for n in nodes:
        _blocks(n, constant, blocks)
    return "\n\n".join(t for b in blocks if (t := " ".join(html.unescape("".join(b)).split())))


def extract(page: str, wrapper: Shape | None, known: dict[tuple[int, str], list[Shape | None]]) -> str:
    """The main text: the wrapper's content. Where that is no article or main element, elements directly in it that say only constant texts are left out.

    Where the wrapper finds nothing: the article, main or body elements, the latter less its constant elements.
    """
    root = tree(page)
    s = shape([root])
    content: list[Node] = []
    constant: set[int] = set()
    if wrapper is not None:
        key = id(wrapper), skeleton(s)
        if key not in known:
            if len(known) > 5000:
                known.clear()
            known[key] = aligned(wrapper, s, False)
        pairs = [(t, x) for t, x in zip(known[key], s.preorder(), strict=True) if t is not None]
        slots = [(t, x) for t, x in pairs if t.flag == CONTENT]
        content = [n for _, x in slots for n in x.nodes]
        if not any(_tag(t) in ("article", "main") for t, _ in slots):
            constant = {id(n) for t, x in pairs if t.common for n in x.nodes if _hash(own_text(n)) in t.common}
    if content and (text := text_of(content, constant)):
        return text
    nodes, todo = [], [root]
    while todo:
        nodes.append(todo.pop())
        todo += [k for k in reversed(nodes[-1].kids) if k.__class__ is Node and not k.out]
    for tag in ("article", "main", "body", "#"):
        if (some := [n for n in nodes if n.tag == tag]) and (text := text_of(some, constant if tag in ("body", "#") else _NONE)):
            return text
    return ""


def host_of(url: str | None) -> str:
    return split_url(url)[0]


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", hosts_held: int = 500, fan: int = 64) -> DataFrame:
    """(host, wrapper): each host's wrapper as JSON, learned from all its pages.

    Tasks merge the pages they read; their templates, bounded by the size of pages, are merged by host in
    groups of at most ``fan`` until one is left, so that no task holds more, however hot the host.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, learner = (task.partitionId() if task else 0), Learner()

        def out() -> pa.RecordBatch:
            rows = list(learner.dump())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([part] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["host", "part", "template"])

        for b in batches:
            for url, page in zip(b.column(0), b.column(1), strict=True):
                learner.add(host_of(url.as_py()), page.as_py() or "")
                if len(learner.hosts) > hosts_held:
                    yield out()
                    learner = Learner()
        yield out()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        first, *others = group.sort_values(["part", "template"])["template"]
        merged = Host.read(first)
        for x in others:
            merged.merge(Host.read(x))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "part": [int(group["g"].iloc[0])], "template": [merged.dump()]})

    schema = "host string, part long, template string"
    t = materialize(pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(learn, schema))
    top = t.agg(F.max("part")).first()[0] or 0
    while True:
        top //= fan
        t = t.withColumn("g", F.floor(F.col("part") / fan)).groupBy("host", "g").applyInPandas(merge, schema)
        if not top:
            break
        t = materialize(t)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [json.dumps(_wrapped(induce(Host.read(x.as_py())))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["host", "wrapper"])

    return t.select("host", "template").mapInArrow(wrap, "host string, wrapper string")


def _wrapped(s: Shape) -> list:
    return [s.label, int(s.out), s.flag, list(s.common), [_wrapped(k) for k in s.kids]]


def _unwrapped(x: list) -> Shape:
    s = Shape(x[0], bool(x[1]))
    s.flag, s.common, s.kids = x[2], dict.fromkeys(x[3], 0), [_unwrapped(k) for k in x[4]]
    return s


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20, salts: int = 64) -> DataFrame:
    """(page_id, url, text) for each row; text is empty where there is none. Null html is empty, a null url has the empty host.

    Wrappers are broadcast where they take at most ``broadcast_bytes``; beyond that pages join
    them by host, a hot host's dealt over ``salts`` tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Shape | None] = {}
        aligned: dict = {}
        for b in batches:
            texts = []
            for page, w in zip(b.column(2), b.column(3), strict=True):
                w = w.as_py()
                if w not in known:
                    if len(known) > 2000:
                        known.clear()
                        aligned.clear()
                    known[w] = _unwrapped(json.loads(w)) if w else None
                texts.append(extract(page.as_py() or "", known[w], aligned))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    wrappers = materialize(templates(pages, url_col, html_col))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    after = F.element_at(F.split("url", "://", 2), 2)
    host = F.when(F.contains(F.col("url"), F.lit("://")), F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    p = p.withColumn("host", F.coalesce(host, F.lit("")))
    if (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= broadcast_bytes:
        p = p.join(F.broadcast(wrappers), "host", "left")
    else:
        dealt = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(dealt, ["host", "salt"], "left")
    return p.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string")
