"""Raw trees of program texts, and what rules make of them.

A scanner cuts a text into tokens; brackets, indentation or end words group
them into statements and blocks.  It is no grammar: it knows where things
begin and end and what they are called, which is what a comparison needs.  Raw
trees keep comments and marks; :func:`normalized` applies the rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .lexing import Token, tokens
from .rules import Rules
from .trees import Comment, Tree

#: Types whose text is their label, whatever lies below them.
TEXTUAL = frozenset({"string", "scalar", "template", "selector"})
_LITERAL = frozenset({"string", "number", "comment"})
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_GROUP = {"(": "parenthesized", "[": "bracketed", "{": "block"}
#: What may follow a block in the same statement, on another line.
_AFTER = frozenset("else catch finally elif except while until elsif rescue ensure when".split())
_CONTROL = frozenset("if for while switch return match loop try with case do foreach unless until import from use package".split())


@dataclass(slots=True)
class Raw:
    kind: str
    start: int
    end: int
    below: list[Raw] = field(default_factory=list)


class _Builder:
    def __init__(self, text: str, rules: Rules):
        self.text, self.rules = text, rules
        self.tokens = tokens(text, rules)
        self.at = 0
        self.errors = sum(t.broken for t in self.tokens)

    def peek(self, past_lines: bool = False) -> Token | None:
        k = self.at
        while past_lines and k < len(self.tokens) and self.tokens[k].kind in ("newline", "comment"):
            k += 1
        return self.tokens[k] if k < len(self.tokens) else None

    def leaf(self, t: Token) -> Raw:
        kind = t.kind
        if kind == "word":
            return Raw("keyword" if t.text in self.rules.keywords else "identifier", t.start, t.end)
        return Raw(kind if kind in _LITERAL else t.text, t.start, t.end)

    def group(self) -> Raw:
        """A bracketed group from its opening mark on; braces hold statements, or entries after a sign that asks for a value."""
        opening, k = self.tokens[self.at], self.at - 1
        while k >= 0 and self.tokens[k].kind in ("newline", "comment"):
            k -= 1
        before = self.tokens[k] if k >= 0 else None
        value = opening.text == "{" and (self.rules.style in ("indent", "end", "tables") or before is not None and (before.text in ("=", "(", "[", ",", ":", "return", "=>", ":=", "?") and before.text != "=>"))
        self.at += 1
        node = Raw("object" if value else _GROUP[opening.text], opening.start, opening.end)
        closing = _CLOSING[opening.text]
        if opening.text == "{" and not value:
            node.below = self.statements(closing)
        else:
            node.below = self.entries(closing)
        last = self.peek()
        if last and last.text == closing:
            self.at += 1
            node.end = last.end
        else:
            self.errors += 1
            node.end = last.start if last else len(self.text)
        return node

    def entries(self, closing: str) -> list[Raw]:
        """What stands between brackets; parts with a key become pairs."""
        out: list[Raw] = []
        part: list[Raw] = []

        def finish() -> None:
            signs = [k for k, r in enumerate(part) if r.kind in (":", "=", "=>")]
            if closing == "}" and signs and 0 < signs[0] < len(part) - 1:
                key, rest = part[: signs[0]], part[signs[0] + 1 :]
                pair = Raw("pair", part[0].start, part[-1].end)
                pair.below = [_wrap("key", key), _wrap("value", rest)]
                out.append(pair)
            else:
                out.extend(part)
            part.clear()

        every, n = self.tokens, len(self.tokens)
        while self.at < n and (t := every[self.at]).kind != "close":
            if t.kind == "newline":
                self.at += 1
            elif t.kind == "open":
                part.append(self.group())
            elif t.text in (",", ";"):
                finish()
                out.append(self.leaf(t))
                self.at += 1
            else:
                part.append(self.leaf(t))
                self.at += 1
        finish()
        return out

    def statements(self, closing: str = "") -> list[Raw]:
        out: list[Raw] = []
        every, n, ended = self.tokens, len(self.tokens), self.rules.style == "end"
        while self.at < n:
            t = every[self.at]
            if t.kind == "close":
                if t.text == closing:
                    break
                if closing and not ended:
                    break  # the caller counts it
                self.errors += 1
                self.at += 1
            elif t.kind == "newline" or t.kind == "comment" or t.text == ";":
                if t.kind != "newline":
                    out.append(self.leaf(t))
                self.at += 1
            elif ended and t.text in ("end", "until") and closing == "end":
                break
            else:
                out.append(self.statement(closing))
        return out

    def statement(self, closing: str) -> Raw:
        items: list[Raw] = []
        start, opened = self.tokens[self.at].start, self.at
        every, n, rules, by_words = self.tokens, len(self.tokens), self.rules, self.rules.style == "end"
        while self.at < n:
            t = every[self.at]
            kind = t.kind
            if kind == "close":
                break
            if kind == "newline":
                following = self.peek(past_lines=True)
                joined = items and items[-1].kind in _JOINING or following is not None and (following.text in (".", "&&", "||", "?", "{", "->") and rules.name != "css" or items and items[-1].kind == "block" and following.text in _AFTER)
                if not joined and (rules.newline_ends or items and items[-1].kind == "block"):
                    break
                self.at += 1
            elif kind == "comment":
                if "\n" not in self.text[items[-1].end : t.start] if items else True:
                    break
                items.append(self.leaf(t))
                self.at += 1
            elif t.text == ";":
                items.append(self.leaf(t))
                self.at += 1
                break
            elif kind == "open":
                items.append(self.group())
            elif by_words and t.text in ("end", "until") and closing == "end":
                break
            elif by_words and t.text in rules.openers and (t.text in ("do", "then", "function", "def", "class", "module", "begin") or self.at == opened):
                items.append(self.leaf(t))
                self.at += 1
                if t.text in ("then", "do", "begin") or rules.name != "lua" or t.text == "function":
                    items += self.ended(t.text)
            else:
                items.append(self.leaf(t))
                self.at += 1
        if self.at == opened:  # a lone comment or bracket
            items.append(self.leaf(self.tokens[self.at]))
            self.at += 1
        return self.named(items, start)

    def ended(self, word: str) -> list[Raw]:
        """The rest of the head's line, then the block up to its end word."""
        head: list[Raw] = []
        if word not in ("do", "then", "begin"):
            while (t := self.peek()) and t.kind not in ("newline", "comment") and t.text != ";":
                if t.text in ("end", "do", "then"):
                    break
                head.append(self.group() if t.kind == "open" else self.leaf(t))
                if t.kind != "open":
                    self.at += 1
            if (t := self.peek()) and t.text in ("do", "then"):
                head.append(self.leaf(t))
                self.at += 1
        start = self.tokens[self.at].start if self.at < len(self.tokens) else len(self.text)
        block = Raw("block", start, start)
        block.below = self.statements("end")
        last = self.peek()
        block.end = last.start if last else len(self.text)
        if last and last.text in ("end", "until"):
            self.at += 1
            return [*head, block, Raw("keyword", last.start, last.end)]
        self.errors += 1
        return [*head, block]

    def named(self, items: list[Raw], start: int) -> Raw:
        """A statement with the type that its words give it, and its name marked."""
        def text(r: Raw) -> str:
            return self.text[r.start : r.end]

        node = Raw("statement", start, items[-1].end, items)
        words = [k for k, r in enumerate(items) if r.kind == "identifier" or r.kind == "keyword"]
        declared = self.rules.declarations
        first = next((k for k in words if text(items[k]) in declared), None) if declared else None
        if first is not None and all(items[k].kind == "keyword" or text(items[k]) in ("pub", "export", "local") for k in words if k < first):
            node.kind = self.rules.declarations[text(items[first])]
            name = next((items[k] for k in words if k > first and items[k].kind == "identifier"), None)
        else:
            opened = next((k for k, r in enumerate(items) if r.kind == "parenthesized"), 0)
            name = items[opened - 1] if opened and items[opened - 1].kind == "identifier" and items[-1].kind == "block" and text(items[0]) not in _CONTROL else None
            if name is not None:
                node.kind = "function_definition"
            elif items and text(items[0]) in _CONTROL:
                node.kind = f"{text(items[0])}_statement"
            elif self.rules.name == "css" and items[-1].kind == "block":
                node.kind, head = "rule", items[:-1]
                node.below = [*([_wrap("selector", head)] if head else []), items[-1]]
            elif any(r.kind in ("=", ":=") for r in items):
                node.kind = "assignment"
            elif len(items) > 2 and items[1].kind == ":" and self.rules.name == "css":
                node.kind = "pair"
                rest = [r for r in items[2:] if r.kind != ";"]
                node.below = [_wrap("key", items[:1]), *([_wrap("value", rest)] if rest else [])]
        if name is not None:
            name.kind = "name"
        return node


#: Last tokens that ask for more on the next line.
_JOINING = frozenset("= , + - * / && || | & -> => . ( [ ? := += == != < >".split())


def _wrap(kind: str, items: list[Raw]) -> Raw:
    """One item as it is, several under a node of their own."""
    node = Raw(kind, items[0].start, items[-1].end)
    node.below = items if len(items) > 1 or items[0].below else []
    if len(items) == 1 and kind == "value":
        return items[0]
    return node


def raw_tree(text: str, rules: Rules) -> tuple[Raw, int]:
    """(root, errors) of a program text."""
    build = _Builder(text, rules)
    root = Raw("program", 0, len(text))
    if rules.style == "indent":
        root.below = _indented(build)
    elif rules.style == "keys":
        root.below, build.errors = _keyed(text)
        root.kind = "document"
    elif rules.style == "tables":
        root.below = _tables(build)
        root.kind = "document"
    else:
        root.below = build.statements()
    return root, build.errors


def _indented(build: _Builder) -> list[Raw]:
    """Statements whose blocks are told by their indentation."""
    text, stack = build.text, []
    root = Raw("block", 0, len(text))
    stack.append((-1, root))
    while t := build.peek():
        if t.kind == "newline":
            build.at += 1
            continue
        column = t.start - (text.rfind("\n", 0, t.start) + 1)
        if t.kind == "comment":
            node = build.leaf(t)
            build.at += 1
        elif t.kind == "close":
            build.errors += 1
            build.at += 1
            continue
        else:
            node = build.statement("")
        while len(stack) > 1 and column <= stack[-1][0] and not (t.kind == "comment" and column == stack[-1][0] and False):
            stack.pop()
        host = stack[-1][1]
        if node.kind == "comment":
            host.below.append(node)
            continue
        host.below.append(node)
        if node.below and node.below[-1].kind == ":":
            block = Raw("block", node.end, node.end)
            node.below.append(block)
            stack.append((column, block))
    _stretch(root)
    return root.below


def _stretch(node: Raw) -> None:
    """Ends of blocks reach as far as what they hold; deep nesting takes no stack."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.below
    for n in reversed(order):
        if n.below:
            n.end = max(n.end, n.below[-1].end)
            if n.kind == "block" and n.below:
                n.start = n.below[0].start
    # Blocks left empty go.
    for n in order:
        n.below = [c for c in n.below if c.kind != "block" or c.below or c.end > c.start]


_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'[^']*'|[^\s#:'"\[\]{}&*!|>%@`,-][^#:\n]*?|-(?=\S)[^#:\n]*?))\s*:(?=\s|$)""")


def _keyed(text: str) -> tuple[list[Raw], int]:
    """Mappings and lists told by indentation."""
    root = Raw("mapping", 0, len(text))
    stack: list[tuple[int, Raw]] = [(-1, root)]
    errors, at, literal = 0, 0, -1
    for line in text.splitlines(keepends=True):
        start, at = at, at + len(line)
        body = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if literal >= 0 and (not body or indent > literal):
            host = stack[-1][1]
            if body:
                if host.below and host.below[-1].kind == "scalar":
                    host.below[-1].end = start + len(line.rstrip())
                else:
                    host.below.append(Raw("scalar", start + indent, start + len(line.rstrip())))
            continue
        literal = -1
        if not body or body in ("---", "..."):
            continue
        errors += "\t" in line[: len(line) - len(line.lstrip())]
        where = start + indent
        while len(stack) > 1 and indent <= stack[-1][0] and not (stack[-1][1].kind == "pair" and body.startswith("- ") and indent == stack[-1][0]):
            stack.pop()
        rest = where
        if text[rest] == "#":
            stack[-1][1].below.append(Raw("comment", rest, start + len(line.rstrip())))
            continue
        while text[rest : rest + 2] == "- " or text[rest : rest + 1] == "-" and not text[rest + 1 : rest + 2].strip():
            item = Raw("item", rest, start + len(line.rstrip()))
            stack[-1][1].below.append(item)
            stack.append((rest - start, item))
            rest += 1
            while text[rest : rest + 1] == " ":
                rest += 1
        end = start + len(line.rstrip())
        if rest >= end:
            continue
        if m := _KEY.match(text, rest, end):
            pair = Raw("pair", m.start(), end, [Raw("key", *m.span(1))])
            stack[-1][1].below.append(pair)
            stack.append((rest - start, pair))
            rest = m.end()
            while rest < end and text[rest] == " ":
                rest += 1
            if rest < end and text[rest] in "|>":
                literal = indent
                continue
        comment = re.compile(r"(?:^|\s)#").search(text, rest, end) if text[rest : rest + 1] not in "\"'" else None
        stop = comment.start() if comment else end
        if text[rest:stop].strip():
            stack[-1][1].below.append(Raw("scalar", rest, rest + len(text[rest:stop].rstrip())))
        if comment:
            stack[-1][1].below.append(Raw("comment", text.index("#", comment.start()), end))
    _stretch(root)
    return root.below, errors


def _tables(build: _Builder) -> list[Raw]:
    """Lines of keys and values under table heads."""
    root = Raw("document", 0, len(build.text))
    host = root
    for node in build.statements():
        head = node.below[0] if node.below else node
        if node.kind == "statement" and head.kind == "bracketed":
            host = Raw("table", node.start, node.end, [Raw("key", head.start, head.end)])
            root.below.append(host)
        elif node.kind == "assignment":
            sign = next(k for k, r in enumerate(node.below) if r.kind == "=")
            left, right = node.below[:sign], node.below[sign + 1 :]
            if left and right:
                node = Raw("pair", node.start, node.end, [_wrap("key", left), _wrap("value", right)])
                node.below[0].below = []
            else:
                build.errors += 1
            host.below.append(node)
        else:
            build.errors += node.kind != "comment"
            host.below.append(node)
    _stretch(root)
    return root.below


def normalized(text: str, root: Raw, errors: int, rules: Rules) -> Tree:
    """The tree that the rules leave of a raw one: dropped, renamed, blanked, flattened and marked nodes."""
    tree = Tree(errors=errors)
    kinds, labels, parents, starts, ends, keyword, unordered = tree.kind, tree.label, tree.parent, tree.start, tree.end, tree.keyword, tree.unordered
    ignored, keywords = rules.ignored, rules.keywords
    todo: list[tuple[Raw, int]] = [(root, -1)]
    while todo:
        raw, parent = todo.pop()
        own, start, end, below = raw.kind, raw.start, raw.end, raw.below
        label = text[start:end].strip() if not below or own in TEXTUAL else ""
        if (own in ignored or label in ignored) and parent >= 0:
            continue
        if own == "error" and parent >= 0:
            todo += [(c, parent) for c in reversed(below)]
            continue
        kind = rules.alias(own, label) if rules.aliased else own
        node = len(kinds)
        kinds.append(kind)
        parents.append(parent)
        starts.append(start)
        ends.append(end)
        labels.append("" if kind in rules.label_ignored else label)
        keyword.append(own in keywords or label in keywords)
        unordered.append(kind in rules.unordered)
        if own in rules.flattened:
            below = [g for c in below if not rules.is_ignored(c.kind, text[c.start : c.end].strip()) for g in c.below]
        if below:
            todo += [(c, node) for c in reversed(below)]
    return tree.finish(text)


def comments(text: str, root: Raw, rules: Rules, tree: Tree) -> list[Comment]:
    """All comments of a raw tree in order.

    The scope is the nearest declaration with its name, and the blocks between
    it and the comment; outside of declarations it starts at ``root``.
    """
    out: list[Comment] = []
    todo: list[tuple[Raw, str, str, str]] = [(root, "", "root", "")]
    while todo:
        raw, parent, scope, path = todo.pop()
        if raw.kind in rules.comments:
            out.append(tree.comment(text, raw.start, raw.end, scope + path, parent))
            continue
        if rules.is_declaration(raw.kind):
            found = sorted((c for c in raw.below if c.kind in rules.identifiers), key=lambda c: c.kind != "name")
            name = text[found[0].start : found[0].end] if found else ""
            scope, path = f"{raw.kind}:{name}" if name else raw.kind, ""
        elif raw.kind in rules.blocks or raw.kind in rules.scaffolding:
            path += f"/{raw.kind}"
        # Leaves that are no comments hold none.
        todo += [(c, raw.kind, scope, path) for c in reversed(raw.below) if c.below or c.kind in rules.comments]
    return out
