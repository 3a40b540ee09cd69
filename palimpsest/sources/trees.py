"""Tree builders for JSON and HTML, and the table of their nodes.

A builder turns a text into a ``Tree``: nodes in pre-order with type, label,
parent and byte range.  Builders are small scanners, not grammars: node types
are our own.  ``errors`` counts what a strict parser would complain about.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import xxhash

#: Containers whose children have no order, where no rules say so.
UNORDERED = frozenset({"object", "attributes"})
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT = frozenset(("script", "style", "textarea", "title"))
#: An open element of the key ends where one of the value starts.
CLOSES = {"p": frozenset("p div ul ol table article section h1 h2 h3 h4 h5 h6".split()), "li": frozenset(("li",)), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
#: Elements that may end without a closing tag.
OPTIONAL_END = frozenset(("p", "li", "tr", "td", "th", "html", "body", "head"))


@dataclass(frozen=True)
class Comment:
    """A comment with its place, in bytes, and the names of what it stands in."""

    text: str
    start: int
    end: int
    row: int
    end_row: int
    scope: str
    parent_kind: str


def bytes_at(text: str):
    """A function from places in code points to places in bytes of UTF-8."""
    if text.isascii():
        return int
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(len(code) + 1, np.int64)
    np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=total[1:])
    return total.tolist().__getitem__


@lru_cache(1024)
def _leaf_shape(kind: str) -> int:
    return xxhash.xxh3_64_intdigest(repr((kind, [])))


@lru_cache(8192)
def _leaf_full(kind: str, label: str) -> int:
    return xxhash.xxh3_64_intdigest(repr((kind, label, [])))


@dataclass
class Tree:
    """Nodes in pre-order; ``finish`` fills the derived columns."""

    kind: list[str] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    keyword: list[bool] = field(default_factory=list)
    unordered: list[bool] = field(default_factory=list)
    #: Comments of the text, which are not nodes.
    comments: list = field(default_factory=list)
    errors: int = 0

    def add(self, kind: str, parent: int, start: int, end: int, label: str = "") -> int:
        for column, value in ((self.kind, kind), (self.label, label), (self.parent, parent), (self.start, start), (self.end, end), (self.keyword, False), (self.unordered, kind in UNORDERED)):
            column.append(value)
        return len(self.kind) - 1

    def __len__(self) -> int:
        return len(self.kind)

    def finish(self, text: str = "") -> Tree:
        """Children, sizes, heights, depths, and child places; offsets become bytes of UTF-8."""
        n = len(self)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.place, self.depth = [-1] * n, [0] * n
        children, place, depth = self.children, self.place, self.depth
        for i, p in enumerate(self.parent):
            if p >= 0:
                row = children[p]
                place[i] = len(row)
                depth[i] = depth[p] + 1
                row.append(i)
        self.size, self.height = [1] * n, [1] * n
        size, height = self.size, self.height
        for i in range(n - 1, -1, -1):
            if below := children[i]:
                total, most = 1, 0
                for c in below:
                    total += size[c]
                    if height[c] > most:
                        most = height[c]
                size[i], height[i] = total, most + 1
        self.byte = bytes_at(text)
        if not text.isascii():
            self.start = [self.byte(k) for k in self.start]
            self.end = [self.byte(k) for k in self.end]
        #: Places where lines begin, in bytes.
        self.lines = [0, *(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1).tolist()]
        if len(self.lines) == 1:
            self.row, self.end_row = [0] * n, [0] * n
        else:
            self.row, self.end_row = ((np.searchsorted(self.lines, at, "right") - 1).tolist() for at in (self.start, self.end))
        # A node's place in post-order is what is before it and in it, without what it lies in.
        self.post_start = [i - d for i, d in enumerate(depth)]
        self._post = [0] * n
        for i, (first, s) in enumerate(zip(self.post_start, size, strict=True)):
            self._post[first + s - 1] = i
        return self

    def _hashes(self) -> None:
        n, kind, label, children = len(self), self.kind, self.label, self.children
        full, shape, digest = [0] * n, [0] * n, xxhash.xxh3_64_intdigest
        for i in range(n - 1, -1, -1):
            # Separators keep ("ab", "c") apart from ("a", "bc").
            if below := children[i]:
                full[i] = digest(repr((kind[i], label[i], [full[c] for c in below])))
                shape[i] = digest(repr((kind[i], [shape[c] for c in below])))
            else:
                full[i] = (_leaf_full if len(label[i]) <= 100 else _leaf_full.__wrapped__)(kind[i], label[i])
                shape[i] = _leaf_shape(kind[i])
        self.full, self.shape = full, shape

    @cached_property
    def full(self) -> list[int]:
        """Hashes of whole subtrees; made when they are first asked for."""
        self._hashes()
        return self.full

    @cached_property
    def shape(self) -> list[int]:
        """The same without labels."""
        self._hashes()
        return self.shape

    def comment(self, text: str, start: int, end: int, scope: str, parent_kind: str) -> Comment:
        """A comment between two places in code points."""
        first, last = self.byte(start), self.byte(end)
        row = bisect_right(self.lines, first) - 1
        return Comment(text[start:end], first, last, row, max(row, bisect_right(self.lines, last - 1) - 1), scope, parent_kind)

    def inside(self, i: int, j: int) -> bool:
        """Whether j is i or lies below it."""
        return i <= j < i + self.size[i]

    def leaves(self, i: int) -> list[int]:
        return [k for k in range(i, i + self.size[i]) if not self.children[k]]

    def up(self, i: int):
        """The ancestors of i, the nearest first."""
        while (i := self.parent[i]) >= 0:
            yield i

    def post_order(self) -> list[int]:
        return self._post


_JSON = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|(-?[0-9][0-9.eE+-]*)|(true|false|null)|(\S))', re.S)


def parse_json(text: str) -> Tree:
    """object (unordered), pair, array, string, number and literals; pairs hold a key and a value."""
    tree = Tree()
    stack = [tree.add("document", -1, 0, len(text))]

    def close(end: int) -> None:
        tree.end[stack.pop()] = end
        if tree.kind[stack[-1]] == "pair":
            tree.end[stack.pop()] = end

    for m in _JSON.finditer(text):
        top = tree.kind[stack[-1]]
        start, end = m.span(m.lastindex)
        mark = m[1]
        if mark and mark in "{[":
            stack.append(tree.add("object" if mark == "{" else "array", stack[-1], start, end))
        elif mark and mark in "}]":
            while len(stack) > 1 and tree.kind[stack[-1]] != ("object" if mark == "}" else "array"):
                tree.errors += 1
                tree.end[stack.pop()] = start
            if len(stack) > 1:
                close(end)
            else:
                tree.errors += 1
        elif mark == ":":
            tree.errors += top != "pair"
        elif mark == ",":
            tree.errors += top not in ("object", "array")
        elif m[5]:
            tree.errors += 1
        elif top == "object":
            tree.errors += not m[2]
            stack.append(tree.add("pair", stack[-1], start, end))
            tree.add("key", stack[-1], start, end, m[m.lastindex])
        else:
            tree.add("string" if m[2] else "number" if m[3] else m[4], stack[-1], start, end, m[m.lastindex])
            if top == "pair":
                tree.end[stack.pop()] = end
    tree.errors += len(stack) - 1
    for i in stack[1:]:
        tree.end[i] = len(text)
    return tree.finish(text)


_TAG = re.compile(r"<!--(.*?)-->|<!([^>]*)>|</([A-Za-z][A-Za-z0-9-]*)[^>]*>|<([A-Za-z][A-Za-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?", re.S)


def _attributes_of(text: str) -> list[tuple[int, int, int, int, str, int, int, str]]:
    """Place of each attribute of a tag, then places and texts of its name and value (an empty text without one)."""
    return [(*a.span(), *a.span(1), a[1], *a.span(2), a[2] or "") for a in _ATTRIBUTE.finditer(text)]


#: Those of short tags, which repeat.
_known_attributes = lru_cache(4096)(_attributes_of)


def parse_html(text: str) -> Tree:
    """document, element (label: tag), attributes (unordered), attribute, name, value, text, raw_text, comment, doctype."""
    tree = Tree()
    kinds, labels, parents, starts, ends = tree.kind, tree.label, tree.parent, tree.start, tree.end

    def add(kind: str, parent: int, start: int, end: int, label: str = "") -> int:
        kinds.append(kind)
        labels.append(label)
        parents.append(parent)
        starts.append(start)
        ends.append(end)
        return len(kinds) - 1

    stack = [add("document", -1, 0, len(text))]
    found_comments: list[tuple[int, int, str, str]] = []
    at = 0

    def words(start: int, end: int, kind: str = "text") -> None:
        if start == end:
            return
        piece = text[start:end]
        if clean := piece.strip():
            begin = start + len(piece) - len(piece.lstrip())
            add(kind, stack[-1], begin, begin + len(clean), clean)

    while m := _TAG.search(text, at):
        first, last = m.span()
        words(at, first)
        at = last
        note, mark, closed, opened_tag, inside = m.groups()
        if note is not None:
            found_comments.append((first, at, "root" + "".join("/" + labels[i] for i in stack[1:]), kinds[stack[-1]]))
        elif mark is not None:
            add("doctype", stack[-1], first, at, mark.strip())
        elif closed:
            tag = closed.lower()
            opened = next((k for k in range(len(stack) - 1, 0, -1) if labels[stack[k]] == tag), 0)
            if not opened:
                tree.errors += 1
                continue
            for i in stack[opened:]:
                ends[i] = at if i == stack[opened] else first
            tree.errors += sum(labels[i] not in OPTIONAL_END for i in stack[opened + 1 :])
            del stack[opened:]
        else:
            tag = opened_tag.lower()
            while len(stack) > 1 and tag in CLOSES.get(labels[stack[-1]], ()):
                ends[stack.pop()] = first
            element = add("element", stack[-1], first, at, tag)
            found = (_known_attributes if len(inside) <= 200 else _attributes_of)(inside) if inside else ()
            if found:
                base = m.start(5)
                group = add("attributes", element, base + found[0][0], base + found[-1][1])
                for low, high, u, v, name, p, q, value in found:
                    one = add("attribute", group, base + low, base + high)
                    add("name", one, base + u, base + v, name)
                    if value:
                        add("value", one, base + p, base + q, value)
            if tag in VOID or inside.endswith("/"):
                continue
            stack.append(element)
            if tag in RAW_TEXT:
                closing = re.compile(f"</{tag}\\s*>", re.I).search(text, at)
                words(at, closing.start() if closing else len(text), "raw_text")
                tree.errors += closing is None
                at = closing.end() if closing else len(text)
                ends[stack.pop()] = at
    words(at, len(text))
    tree.errors += sum(labels[i] not in OPTIONAL_END for i in stack[1:])
    for i in stack[1:]:
        ends[i] = len(text)
    tree.keyword = [False] * len(kinds)
    tree.unordered = [k in UNORDERED for k in kinds]
    tree.finish(text)
    tree.comments = [tree.comment(text, *c) for c in found_comments]
    return tree
