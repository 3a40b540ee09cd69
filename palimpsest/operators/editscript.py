"""Edit scripts: insert, update, move and delete actions that turn one tree into another.

``script`` works over a working copy of the source: the destination is walked
level by level, children of mapped pairs are aligned by a longest common
subsequence, and what has no partner is deleted in post-order at the end.
``apply`` replays a script, which the tests use as the invariant.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.parsing import parse
from ..sources.rules import LANGUAGES
from ..sources.trees import Tree
from .spread import spread
from .treematch import Matching, Partition, _longest_common, match


@dataclass
class Action:
    """``node`` and ``parent`` are ids of the working copy: source ids, or len(source) + id for inserted nodes.

    ``position`` counts the parent's children after the node has left its old place.
    """

    action: str
    node: int
    dest: int = -1
    parent: int = -1
    position: int = 0
    old_value: str | None = None
    new_value: str | None = None
    subtree: bool = False


class _Copy:
    """Working copy of a tree under an extra root with id -1."""

    def __init__(self, t: Tree):
        self.parent = dict(enumerate(t.parent))
        self.below: dict[int, list[int]] = {-1: [0] if len(t) else [], **{i: list(c) for i, c in enumerate(t.children)}}

    def place(self, node: int, parent: int, position: int) -> None:
        self.parent[node] = parent
        self.below.setdefault(node, [])
        self.below[parent].insert(position, node)

    def take(self, node: int) -> None:
        self.below[self.parent[node]].remove(node)


def script(m: Matching) -> list[Action]:
    a, b = m.a, m.b
    copy, out = _Copy(a), []
    there = {i: int(y) for i, y in enumerate(m.to) if y >= 0}
    here = {y: i for i, y in there.items()}
    there[-1] = here[-1] = -1
    settled: set[int] = set()  # destination nodes whose place among their siblings is right

    def position(y: int) -> int:
        p = b.parent[y]
        siblings = b.children[p] if p >= 0 else [0]
        for s in reversed(siblings[: max(b.place[y], 0)]):
            if s in settled and s in here and copy.parent[here[s]] == here[p]:
                return copy.below[here[p]].index(here[s]) + 1
        return 0

    def move(w: int, y: int) -> None:
        copy.take(w)
        at = position(y)
        copy.place(w, here[b.parent[y]], at)
        out.append(Action("move", w, y, here[b.parent[y]], at, subtree=bool(copy.below[w])))
        settled.add(y)

    queue = deque([0] if len(b) else [])
    while queue:
        y = queue.popleft()
        queue.extend(b.children[y])
        p = b.parent[y]
        if y not in here:
            w, at = len(a) + y, position(y)
            copy.place(w, here[p], at)
            here[y], there[w] = w, y
            settled.add(y)
            out.append(Action("insert", w, y, here[p], at, new_value=b.label[y]))
        else:
            w = here[y]
            if a.label[w] != b.label[y]:
                out.append(Action("update", w, y, old_value=a.label[w], new_value=b.label[y]))
            if copy.parent[w] != here[p]:
                move(w, y)
        if not b.children[y]:
            continue
        # Children that are already below the right parent.
        ours = [c for c in copy.below[w] if there.get(c, -1) >= 0 and b.parent[there[c]] == y]
        if b.unordered[y]:
            settled.update(there[c] for c in ours)
            continue
        theirs = [c for c in b.children[y] if c in here and copy.parent[here[c]] == w]
        kept = _longest_common(ours, theirs, there.__getitem__, lambda c: c)
        settled.update(c for _, c in kept)
        for c in theirs:
            if c not in settled:
                move(here[c], c)
    todo = [(-1, False)]
    gone = []
    while todo:
        i, seen = todo.pop()
        if seen:
            if i not in there:
                gone.append(i)
        else:
            todo.append((i, True))
            todo += [(c, False) for c in reversed(copy.below[i])]
    out += [Action("delete", i, old_value=a.label[i]) for i in gone]
    return out


def apply(a: Tree, b: Tree, actions: list[Action]) -> tuple:
    """The tree that ``actions`` make of ``a``, as nested (type, label, children); types of new nodes come from ``b``."""
    copy = _Copy(a)
    kind, label = dict(enumerate(a.kind)), dict(enumerate(a.label))
    for x in actions:
        if x.action == "update":
            label[x.node] = x.new_value
        elif x.action == "delete":
            assert not copy.below[x.node]
            copy.take(x.node)
        else:
            if x.action == "move":
                copy.take(x.node)
            else:
                kind[x.node], label[x.node] = b.kind[x.dest], x.new_value
            copy.place(x.node, x.parent, x.position)

    def nested(i: int) -> tuple:
        return kind[i], label[i], tuple(nested(c) for c in copy.below[i])

    return tuple(nested(i) for i in copy.below[-1])


def collapse(m: Matching, actions: list[Action]) -> list[Action]:
    """Whole inserted or deleted subtrees become one action on their top node."""

    def whole(t: Tree, partner) -> list[bool]:
        out = [False] * len(t)
        for i in range(len(t) - 1, -1, -1):
            out[i] = partner[i] < 0 and all(out[c] for c in t.children[i])
        return out

    new, old = whole(m.b, m.back), whole(m.a, m.to)
    kept = []
    for x in actions:
        if x.action in ("insert", "delete"):
            t, i, all_of = (m.b, x.dest, new) if x.action == "insert" else (m.a, x.node, old)
            p = t.parent[i]
            if all_of[i] and p >= 0 and all_of[p]:
                continue
            x.subtree = all_of[i] and bool(t.children[i])
        kept.append(x)
    return kept


ACTIONS = """a long, b long, seq int, action string, type string, node_id int, dest_id int, parent_id int, position int,
    old_value string, new_value string, subtree boolean, start_byte int, end_byte int, dest_start_byte int, dest_end_byte int"""
#: Rows of a result batch, beyond which the pair at hand is the last in it.
OUT_ROWS = 8192
MAPPINGS = "a long, b long, src_id int, dst_id int, type string, src_label string, dst_label string"
#: Characters of two texts whose result a task remembers, and how many such results.
SHORT_PAIR = 400
KNOWN_PAIRS = 20_000
#: Shares that equal pairs of texts are dealt to, so that no task gets all of a frequent one.
SHARES = 8


def _kernel(pairs: DataFrame, lang: str, schema: str, rows, columns: Sequence[str] | None = None) -> DataFrame:
    """``rows(matching)`` for every pair (a, b, src, dst), one pair at a time; with ``columns`` only those leave the tasks.

    Pairs of equal texts meet in a few tasks, which compare short ones once.
    """
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    every = [c.strip() for c in schema.split(",")]
    wanted = [k for k, c in enumerate(every) if columns is None or c.split()[0] in columns]
    kind = pa.schema([(name, types[t]) for name, t in (every[k].split() for k in wanted)])
    #: Which of a and b, and which of the rows' values.
    keys, values = [k for k in wanted if k < 2], [k - 2 for k in wanted if k >= 2]

    def compared(src: str, dst: str) -> tuple[int, list[list]]:
        left, right = parse(src, lang), parse(dst, lang)
        found = list(rows(match(left, right, LANGUAGES[lang], Partition(src, dst, left, right))))
        return len(found), [[r[k] for r in found] for k in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in wanted]
        known: dict[tuple[str, str], tuple[int, list[list]]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, kind, strict=True)], names=kind.names)
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for *pair, src, dst in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                src, dst = src or "", dst or ""
                found = known.get((src, dst))
                if found is None:
                    found = compared(src, dst)
                    if len(src) + len(dst) <= SHORT_PAIR:
                        if len(known) == KNOWN_PAIRS:
                            known.clear()
                        known[src, dst] = found
                n, parts = found
                if not n:
                    continue
                for column, part in zip(held, ([pair[k]] * n for k in keys), strict=False):
                    column += part
                for column, part in zip(held[len(keys) :], parts, strict=True):
                    column += part
                if len(held[0]) >= OUT_ROWS:
                    yield flush()
        yield flush()

    texts = pairs.select("a", "b", "src", "dst")
    dealt = spread(texts, F.xxhash64("src", "dst"), F.pmod(F.xxhash64("a", "b"), F.lit(SHARES)))
    return dealt.mapInArrow(run, ", ".join(every[k] for k in wanted))


def tree_mappings(pairs: DataFrame, lang: str) -> DataFrame:
    def rows(m: Matching):
        return [(x, int(y), m.a.kind[x], m.a.label[x], m.b.label[y]) for x, y in enumerate(m.to) if y >= 0]

    return _kernel(pairs, lang, MAPPINGS, rows)


def tree_actions(pairs: DataFrame, lang: str, collapsed: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Actions of every pair in order.  ``parent_id`` is of the destination; an absent side has nulls.

    With ``columns`` only those, in the order of ``ACTIONS``.
    """

    def rows(m: Matching):
        a, b = m.a, m.b
        found = script(m)
        for seq, x in enumerate(collapse(m, found) if collapsed else found):
            old, new = x.node < len(a), x.dest >= 0
            yield (
                seq, x.action, a.kind[x.node] if old else b.kind[x.dest], x.node if old else None, x.dest if new else None,
                b.parent[x.dest] if x.action in ("insert", "move") else None, x.position, x.old_value, x.new_value, x.subtree,
                a.start[x.node] if old else None, a.end[x.node] if old else None, b.start[x.dest] if new else None, b.end[x.dest] if new else None,
            )

    return _kernel(pairs, lang, ACTIONS, rows, columns)


def action_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("a", "b", "action").agg(F.count(F.lit(1)).alias("n"))

