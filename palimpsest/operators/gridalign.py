"""Side-by-side grids of two texts, led by the matching of their trees."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from ..functions.text import TRIVIAL_ANCHORS, TRIVIAL_BRACKETS
from ..sources.trees import Tree
from .edits import Edit
from .treematch import Matching

# Fixed values of the format.
EQUAL, PER_LEAF, PER_LEAF_EQUAL = 1000, 100, 10
#: Rows that a move may shift inside its container without being displaced.
SHIFT = 2
#: Cells of a table held at once; larger regions are halved, with the same best weight.
MAX_CELLS = 4_000_000

Grid = list[tuple[int, int]]


def is_displaced(m: Matching, x: int, y: int) -> bool:
    """Whether a moved node shows on other rows: not if it hardly shifts inside its nearest mapped container."""
    a, b = m.a, m.b
    host = next((p for p in a.up(x) if m.to[p] >= 0), -1)
    if host >= 0:
        there = int(m.to[host])
        inside = b.row[there] <= b.row[y] and b.end_row[y] <= b.end_row[there]
        if inside and abs((a.row[x] - a.row[host]) - (b.row[y] - b.row[there])) <= SHIFT:
            return False
    return a.row[x] != b.row[y]


def moved_rows(m: Matching, edits: list[Edit]) -> tuple[set[int], set[int]]:
    """Rows of nodes and comments that went to a place which does not correspond to their old one."""
    left: set[int] = set()
    right: set[int] = set()
    for e in edits:
        if e.action != "move" or e.left is None or e.right is None:
            continue
        if e.origin == "tree":
            p, q = m.a.parent[e.src], m.b.parent[e.dst]
            if p >= 0 and q >= 0 and m.to[p] == q or not is_displaced(m, e.src, e.dst):
                continue
        left.update(range(e.left.row, e.left.end_row + 1))
        right.update(range(e.right.row, e.right.end_row + 1))
    return left, right


def row_targets(m: Matching) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
    """Rows on which the partners of the nodes that begin on a row begin, in both directions."""
    to, back = defaultdict(set), defaultdict(set)
    for x in np.flatnonzero(m.to >= 0).tolist():
        i, j = m.a.row[x], m.b.row[int(m.to[x])]
        to[i].add(j)
        back[j].add(i)
    return to, back


def line_overlap(m: Matching) -> dict[tuple[int, int], int]:
    """How many mapped pairs of leaves each pair of rows shares."""
    out: dict[tuple[int, int], int] = defaultdict(int)
    for x in np.flatnonzero(m.to >= 0).tolist():
        if not m.a.children[x]:
            out[m.a.row[x], m.b.row[int(m.to[x])]] += 1
    return out


class _Containers:
    """For each row the smallest inner node around it."""

    def __init__(self, t: Tree):
        self.t = t
        self.known: dict[int, int] = {}

    def of(self, row: int) -> int:
        if row not in self.known:
            t, i, best = self.t, 0, -1
            while len(t) and t.row[i] <= row <= t.end_row[i]:
                if i and t.children[i]:
                    best = i
                i = next((c for c in t.children[i] if t.row[c] <= row <= t.end_row[c]), -1)
                if i < 0:
                    break
            self.known[row] = best
        return self.known[row]


def containers_correspond(m: Matching, x: int, y: int) -> bool:
    """Some mapped one of x and its ancestors has its partner in y and its ancestors; the roots do not count."""
    if x < 0 or y < 0:
        return x == y
    above = {y, *m.b.up(y)} - {0}
    return any(i and int(m.to[i]) in above for i in (x, *m.a.up(x)))


class _Lines:
    """What the alignment knows of both texts."""

    def __init__(self, left: list[str], right: list[str], m: Matching | None, edits: list[Edit]):
        self.left, self.right, self.m = left, right, m
        self.moved_left, self.moved_right = moved_rows(m, edits) if m else (set(), set())
        self.to, self.back = row_targets(m) if m else ({}, {})
        number: dict[str, int] = {}
        self.a = np.array([number.setdefault(x, len(number)) for x in left])
        self.b = np.array([number.setdefault(x, len(number)) for x in right])
        self.by_left: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (i, j), n in (line_overlap(m) if m else {}).items():
            self.by_left[i].append((j, n))
        self.still_left = np.array([i not in self.moved_left for i in range(len(left))], bool)
        self.still_right = np.array([j not in self.moved_right for j in range(len(right))], bool)
        self.around = (_Containers(m.a), _Containers(m.b)) if m else None

    def elsewhere(self, i: int, j: int) -> bool:
        """A row whose nodes have partners on another row than the given one."""
        to, back = self.to.get(i, ()), self.back.get(j, ())
        return len(to) > 1 or len(to) == 1 and j not in to or len(back) > 1 or len(back) == 1 and i not in back

    def anchors(self) -> Grid:
        out: Grid = []
        last = -1
        for i, line in enumerate(self.left):
            to = self.to.get(i, ())
            if len(to) != 1 or not self.still_left[i]:
                continue
            (j,) = to
            if last < j < len(self.right) and self.still_right[j] and self.back[j] == {i} and line == self.right[j]:
                out.append((i, j))
                last = j
        return out

    def weights(self, i: int, low: int, high: int) -> np.ndarray:
        """How well line i goes with each of the right lines of a range; 0 where it does not."""
        out = np.zeros(high - low, np.int64)
        if not self.still_left[i]:
            return out
        equal = np.flatnonzero(self.b[low:high] == self.a[i])
        out[equal] = EQUAL
        if len(equal) and self.around and self.left[i].strip() in TRIVIAL_BRACKETS:
            for k in equal.tolist():
                if not containers_correspond(self.m, self.around[0].of(i), self.around[1].of(low + k)):
                    out[k] = 0
        for j, n in self.by_left.get(i, ()):
            if low <= j < high:
                out[j - low] = EQUAL + PER_LEAF_EQUAL * n if self.b[j] == self.a[i] else PER_LEAF * n
        out[~self.still_right[low:high]] = 0
        return out


def _region(w: _Lines, i0: int, i1: int, j0: int, j1: int) -> Grid:
    """Grid rows between two anchors: equal ends, then the heaviest alignment of the rest."""
    def fixed(i: int, j: int) -> bool:
        return w.left[i] == w.right[j] and bool(w.still_left[i] and w.still_right[j]) and not w.elsewhere(i, j)

    head: Grid = []
    while i0 < i1 and j0 < j1 and fixed(i0, j0):
        head.append((i0, j0))
        i0, j0 = i0 + 1, j0 + 1
    tail: Grid = []
    while i0 < i1 and j0 < j1 and fixed(i1 - 1, j1 - 1):
        i1, j1 = i1 - 1, j1 - 1
        tail.append((i1, j1))
    return head + _heaviest(w, i0, i1, j0, j1) + tail[::-1]


def _step(above: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The next row of the table of best weights."""
    row = above.copy()
    row[1:] = np.maximum(row[1:], np.where(weight > 0, above[:-1] + weight, 0))
    return np.maximum.accumulate(row)


def _heaviest(w: _Lines, i0: int, i1: int, j0: int, j1: int) -> Grid:
    n, k = i1 - i0, j1 - j0
    if not n or not k:
        return [(i, -1) for i in range(i0, i1)] + [(-1, j) for j in range(j0, j1)]
    if n * k > MAX_CELLS and n > 1:
        # Both halves of the left side meet where their best weights add up to most.
        mid = (i0 + i1) // 2
        front = np.zeros(k + 1, np.int64)
        for i in range(i0, mid):
            front = _step(front, w.weights(i, j0, j1))
        back = np.zeros(k + 1, np.int64)
        for i in range(i1 - 1, mid - 1, -1):
            back = _step(back, w.weights(i, j0, j1)[::-1])
        cut = j0 + int(np.argmax(front + back[::-1]))
        return _heaviest(w, i0, mid, j0, cut) + _heaviest(w, mid, i1, cut, j1)
    if w.m is None:
        return _equal_lines(w.a[i0:i1].tolist(), w.b[j0:j1].tolist(), i0, j0)
    weight = [w.weights(i, j0, j1) for i in range(i0, i1)]
    table = [np.zeros(k + 1, np.int64)]
    for row in weight:
        table.append(_step(table[-1], row))
    out: Grid = []
    i, j = n, k
    while i or j:
        if i and j and weight[i - 1][j - 1] > 0 and table[i][j] == table[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
        elif i and (not j or table[i - 1][j] > table[i][j - 1]):
            i -= 1
            out.append((i0 + i, -1))
        else:
            j -= 1
            out.append((-1, j0 + j))
    return out[::-1]


def _equal_lines(a: list[int], b: list[int], i0: int, j0: int) -> Grid:
    """The same where only equal lines have a weight, all of them the same: the table of best weights is a number a row.

    A bit of such a number is 0 where the weight rises by one line from the place before it.
    """
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    rows, row = [every], every
    for x in a:
        both = row & places.get(x, 0)
        row = (row + both | row - both) & every
        rows.append(row)
    out: Grid = []
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
        elif rows[i] >> j - 1 & 1:
            j -= 1
            out.append((-1, j0 + j))
        else:
            i -= 1
            out.append((i0 + i, -1))
    out += [(i0 + k, -1) for k in range(i - 1, -1, -1)] + [(-1, j0 + k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def _plain(left: list[str], right: list[str]) -> Grid | None:
    """The region of both whole texts without trees; none if its table is to be halved."""
    n, k, low = len(left), len(right), 0
    while low < n and low < k and left[low] == right[low]:
        low += 1
    high = 0
    while high < n - low and high < k - low and left[n - 1 - high] == right[k - 1 - high]:
        high += 1
    if (n - low - high) * (k - low - high) > MAX_CELLS:
        return None
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in side[low : len(side) - high]] for side in (left, right))
    return [(i, i) for i in range(low)] + _equal_lines(a, b, low, low) + [(n - i, k - i) for i in range(high, 0, -1)]


def side_by_side(grid: Grid, left: list[str], moved_left: set[int], moved_right: set[int]) -> Grid:
    """Between aligned rows, what has no partner stands side by side; moved rows stand alone, and comment marks end no block."""
    out: Grid = []
    block: tuple[list[int], list[int]] = ([], [])

    def zipped(i: list[int], j: list[int]) -> None:
        for k in range(max(len(i), len(j))):
            out.append((i[k] if k < len(i) else -1, j[k] if k < len(j) else -1))
        i.clear()
        j.clear()

    def flush() -> None:
        plain: tuple[list[int], list[int]] = ([], [])
        for side, moved in ((0, moved_left), (1, moved_right)):
            for row in block[side]:
                if row in moved:
                    zipped(*plain)
                    out.append((row, -1) if side == 0 else (-1, row))
                else:
                    plain[side].append(row)
            block[side].clear()
        zipped(*plain)

    for i, j in grid:
        if i >= 0 and j >= 0 and not (any(block) and left[i].strip() in TRIVIAL_ANCHORS):
            flush()
            out.append((i, j))
        else:
            if i >= 0:
                block[0].append(i)
            if j >= 0:
                block[1].append(j)
    flush()
    return out


def align(src: str, dst: str, m: Matching | None = None, edits: list[Edit] | None = None) -> Grid:
    """(left line, right line) of each grid row; -1 is a filler.  An empty side is all filler."""
    left, right = src.split("\n"), dst.split("\n")
    if not src:
        return [(-1, j) for j in range(len(right))]
    if not dst:
        return [(i, -1) for i in range(len(left))]
    if m is None and (plain := _plain(left, right)) is not None:
        return side_by_side(plain, left, set(), set())
    w = _Lines(left, right, m, edits or [])
    grid: Grid = []
    i = j = 0
    for p, q in [*w.anchors(), (len(left), len(right))]:
        grid += _region(w, i, p, j, q)
        if p < len(left):
            grid.append((p, q))
        i, j = p + 1, q + 1
    return side_by_side(grid, left, w.moved_left, w.moved_right)
