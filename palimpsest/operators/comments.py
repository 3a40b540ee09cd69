"""Comments of two texts: which are the same, which moved, which changed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from ..functions.similarity import bigram_similarity
from ..sources.trees import Comment
from .edits import Edit, Span
from .linediff import match_lines

# Fixed values of the method.
FAR = 25
WINDOW = 60
ALIKE = 0.40
ALIKE_BLOCKS = 0.20
ALIKE_LINES = 0.45

#: Kinds of offers, the surest first, and none.
SAME, NEAR, LIKE, GONE = range(4)


def _span(c: Comment) -> Span:
    return Span("comment", c.text, c.start, c.end, c.row, c.end_row, c.parent_kind)


def line_spans(c: Comment) -> list[Span]:
    """The lines of a comment with their places."""
    out, at = [], c.start
    for k, line in enumerate(c.text.split("\n")):
        size = len(line.encode())
        out.append(Span("comment", line, at, at + size, c.row + k, c.row + k, c.parent_kind))
        at += size + 1
    return out


def assign(offers: Iterable[tuple]) -> dict[int, tuple]:
    """From offers (rank, i, j) the best first, each i and each j once: i to its offer."""
    given: dict[int, tuple] = {}
    used: set[int] = set()
    for offer in sorted(offers):
        if offer[1] not in given and offer[2] not in used:
            given[offer[1]] = offer
            used.add(offer[2])
    return given


def _offers(left: list[Comment], right: list[Comment]) -> Iterator[tuple]:
    """What could be what: ranked by kind (``SAME``, ``NEAR``, ``LIKE``), then by likeness, then by distance in rows."""
    by_text: dict[str, list[int]] = defaultdict(list)
    by_scope: dict[str, list[int]] = defaultdict(list)
    for j, d in enumerate(right):
        by_text[d.text].append(j)
        by_scope[d.scope].append(j)
    for i, c in enumerate(left):
        for j in by_text[c.text]:
            away = abs(c.row - right[j].row)
            if c.scope == right[j].scope:
                yield (SAME, 0.0, away), i, j
            if away < FAR:
                yield (NEAR, 0.0, away), i, j
        for j in by_scope[c.scope]:
            away = abs(c.row - right[j].row)
            if away <= WINDOW and right[j].text != c.text:
                score = bigram_similarity(c.text, right[j].text)
                if score >= (ALIKE_BLOCKS if "\n" in c.text and "\n" in right[j].text else ALIKE):
                    yield (LIKE, -score, away), i, j


def compare(left: list[Comment], right: list[Comment]) -> list[Edit]:
    """Edits of comments: each comment of the one side goes to at most one of the other, the surest offers first.

    Equal comments of one scope are the same; equal ones nearby in another scope
    have moved; in one scope, those that are alike and not far have changed; the rest is gone or new.
    Edits follow the order of the first text, then that of the second.
    """
    given = assign(_offers(left, right))
    out: list[Edit] = []
    for i, c in enumerate(left):
        (kind, *_), _, j = given.get(i, ((GONE,), i, -1))
        if kind == LIKE:
            out += changed(c, right[j])
        elif kind == NEAR and c.scope != right[j].scope:
            out.append(Edit("move", "comment", left=_span(c), right=_span(right[j])))
        elif kind == GONE:
            out.append(Edit("delete", "comment", old_value=c.text, left=_span(c)))
    kept = {j for _, _, j in given.values()}
    return out + [Edit("insert", "comment", new_value=d.text, right=_span(d)) for j, d in enumerate(right) if j not in kept]


def changed(c: Comment, d: Comment) -> list[Edit]:
    """One update of a comment of one line; of longer ones the updated, deleted and inserted lines.

    Equal lines stay as the comparison of lines says; the others go to the line that is most alike.
    """
    if "\n" not in c.text + d.text:
        return [Edit("update", "comment", old_value=c.text, new_value=d.text, left=_span(c), right=_span(d))]
    a, b = line_spans(c), line_spans(d)
    same = match_lines([s.label for s in a], [s.label for s in b])
    rest_a, rest_b = set(range(len(a))) - {i for i, _ in same}, set(range(len(b))) - {j for _, j in same}
    scored = ((-bigram_similarity(a[i].label, b[j].label), i, j) for i in rest_a for j in rest_b)
    pairs = {i: j for i, (_, _, j) in assign(o for o in scored if -o[0] > ALIKE_LINES).items()}
    out = []
    for i in sorted(rest_a):
        if i in pairs:
            out.append(Edit("update", "comment", old_value=a[i].label, new_value=b[pairs[i]].label, left=a[i], right=b[pairs[i]]))
        else:
            out.append(Edit("delete", "comment", old_value=a[i].label, left=a[i]))
    return out + [Edit("insert", "comment", new_value=b[j].label, right=b[j]) for j in sorted(rest_b - set(pairs.values()))]
