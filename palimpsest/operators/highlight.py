"""Highlights: the byte spans of edits on one side, cut at line ends and merged where only gaps lie between."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

# Fixed values of the format.
ORDER = ("delete", "insert", "update", "move")
GAP = 3
_SOLID = re.compile(rb"[<>=+\-*/%!&|^~?A-Za-z0-9_]")

Range = tuple[int, int]


@dataclass(frozen=True)
class Mark:
    """A span of an edit, with what decides whether neighbours may join."""

    start: int
    end: int
    action: str
    #: Number of the edit, its length on this side, its group, and the ranges of its new and old parent.
    edit: int = -1
    size: int = 0
    group: str | None = None
    parent: Range | None = None
    old_parent: Range | None = None


def line_starts(raw: bytes) -> list[int]:
    out = [0]
    while (k := raw.find(b"\n", out[-1])) >= 0:
        out.append(k + 1)
    return out


def pieces(start: int, end: int, lines: list[int], size: int) -> list[tuple[int, int, int]]:
    """(line, first column, last column) of a span, without line ends; empty ones are left out."""
    out = []
    first = bisect_right(lines, start) - 1
    for k in range(max(first, 0), len(lines)):
        if lines[k] >= end:
            break
        stop = lines[k + 1] - 1 if k + 1 < len(lines) else size
        low, high = max(start, lines[k]), min(end, stop)
        if low < high:
            out.append((k, low - lines[k], high - lines[k]))
    return out


def _kin(p: Range | None, q: Range | None) -> bool:
    """Equal ranges, or one around the other; two that are missing are equal."""
    if p is None or q is None:
        return p is q
    return p[0] <= q[0] and q[1] <= p[1] or q[0] <= p[0] and p[1] <= q[1]


def _joins(p: Mark, q: Mark) -> bool:
    if p.action in ("delete", "insert"):
        return True
    if p.group and p.group == q.group:
        return True
    return _kin(p.parent, q.parent) and (p.action == "update" or _kin(p.old_parent, q.old_parent))


def highlights(raw: bytes, marks: list[Mark]) -> list[tuple[int, int, int, str, int]]:
    """(line, first column, last column, action, edit) in order."""
    if not raw:
        return []
    lines = line_starts(raw)
    by_line: dict[tuple[int, str], list[tuple[int, int, Mark]]] = defaultdict(list)
    for mark in marks:
        for line, low, high in pieces(mark.start, mark.end, lines, len(raw)):
            by_line[line, mark.action].append((low, high, mark))
    out = []
    for (line, action), spans in by_line.items():
        spans.sort(key=lambda s: s[:2])
        low, high, mark = spans[0]
        for start, end, other in spans[1:]:
            if start >= low and end <= high:
                if other.edit != mark.edit:
                    out.append((line, start, end, action, other.edit))
                continue
            between = raw[lines[line] + high : lines[line] + start] if start > high else b""
            if start - high <= GAP and not _SOLID.search(between) and _joins(mark, other):
                if end > high:
                    if start == low and other.edit != mark.edit:
                        out.append((line, low, high, action, mark.edit))
                    if other.size > mark.size:
                        mark = other
                    high = end
            else:
                out.append((line, low, high, action, mark.edit))
                low, high, mark = start, end, other
        out.append((line, low, high, action, mark.edit))
    return sorted(out, key=lambda s: (s[0], s[1], s[2], s[3]))
