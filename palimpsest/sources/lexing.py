"""Tokens of program texts.

One pattern for each language finds comments, strings, numbers, words,
brackets and signs.  What depends on what came before is told by state: a slash that
begins a regular expression, documents that begin on the line after their tag, the closing bracket of
a case label, and texts between tags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .rules import Rules


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    #: A string or comment without its end.
    broken: bool = False


def _plain(quote: str) -> str:
    """A quoted string that may hold line ends."""
    return rf"{quote}(?:[^{quote}\\]|\\.)*{quote}"


#: Forms of literals and comments that a language has beside the usual ones.
_FORMS: dict[str, tuple[tuple[str, str], ...]] = {
    "cpp": (("string", r'(?:u8|[uUL])?R"(?P<cpp_mark>[^()\\\s]{0,16})\(.*?\)(?P=cpp_mark)"'), ("number", r"\d(?:'?[\w.])+")),
    "csharp": (("string", r'\$*"""+.*?"""+'), ("string", r'(?:\$@|@\$|@)"(?:[^"]|"")*"')),
    "java": (("string", r'"""(?:[^\\]|\\.)*?"""'),),
    "rust": (("string", r'b?r(?P<rust_mark>\#*)".*?"(?P=rust_mark)'), ("string", "b?" + _plain('"')), ("string", r"b?'(?:\\(?:u\{[^}\n]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'")),
    "zig": (("string", r"\\\\[^\n]*"),),
    "lua": (("comment", r"--\[(?P<lua_note>=+)\[.*?\](?P=lua_note)\]"), ("string", r"\[(?P<lua_mark>=*)\[.*?\](?P=lua_mark)\]")),
    "ruby": (("comment", r"(?m:^)=begin\b.*?\n=end[^\n]*"), ("heredoc", r"<<(?:[~-](?P<ruby_quote>[\"'`]?)\w+(?P=ruby_quote)|(?P<ruby_other>[\"'`])\w+(?P=ruby_other))"), ("string", _plain('"')), ("string", _plain("'"))),
    "php": (("string", r"\?>.*?(?:<\?(?:php\b|=)?|\Z)"), ("heredoc", r"<<<[ \t]*(?P<php_quote>[\"']?)\w+(?P=php_quote)"), ("string", _plain('"')), ("string", _plain("'"))),
    "bash": (("word", r"\$\{(?:\"(?:[^\"\\]|\\.)*\"|[^{}\"]|\{[^{}]*\})*\}"), ("comment", r"(?<![^\s;&|()`])\#[^\n]*"), ("mark", r"\$?\#|\\."), ("heredoc", r"<<-?[ \t]*(?P<bash_quote>[\"']?)\w+(?P=bash_quote)(?!<)"), ("string", r"'[^']*'"), ("string", _plain('"'))),
}
#: Languages whose comment signs stand in the forms above.
_OWN_COMMENTS = frozenset({"bash"})
#: Languages with regular expressions between slashes, and with tags among expressions.
_REGEX = frozenset({"javascript", "typescript", "tsx", "ruby"})
_TAGS = frozenset({"javascript", "tsx"})
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_OPENING_TAG = re.compile(r"<(?=[A-Za-z>])")
#: Words after which a value comes.
_ASKING = frozenset("return typeof case in of delete void throw new else do and or not if unless when while until then instanceof await yield default".split())


@lru_cache(maxsize=64)
def _scanner(name: str, line: tuple, block: tuple, quotes: str, long_quotes: tuple) -> re.Pattern:
    forms = [f"(?P<{kind}_{k}>{form})" for k, (kind, form) in enumerate(_FORMS.get(name, ()))]
    notes = [*(re.escape(a) + ".*?(?:" + re.escape(b) + r"|$(?![\r\n]))" for a, b in block), *(re.escape(x) + "[^\\n]*" for x in line if name not in _OWN_COMMENTS)]
    parts = [f"(?P<comment>{'|'.join(notes)})"] if notes else []
    strings = [re.escape(q) + r"(?:[^\\]|\\.)*?(?:" + re.escape(q) + r"|$(?![\r\n]))" for q in long_quotes]
    strings += [re.escape(q) + r"(?:[^\\" + re.escape(q) + r"\n]|\\.)*(?:" + re.escape(q) + r"|(?=\n)|$)" for q in quotes if q not in long_quotes]
    if strings:
        parts.append(rf"(?P<string>{'|'.join(strings)})")
    parts += [
        r"(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)", r"(?P<word>[@!]?[^\W\d][\w]*(?:-[\w]+(?=\s*:))?)", r"(?P<open>[(\[{])", r"(?P<close>[)\]}])", r"(?P<newline>\r?\n)",
        r"(?P<mark>=>|->|::|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\.\.\.|[-+*/%&|^<>]=|[^\s\w])",
    ]
    return re.compile("|".join([*forms, *parts]), re.S)


def _wants_value(out: list[Token]) -> bool:
    """Whether a value may begin after the tokens so far."""
    last = next((t for t in reversed(out) if t.kind not in ("newline", "comment")), None)
    if last is None or last.kind == "open":
        return True
    if last.kind == "word":
        return last.text in _ASKING
    return last.kind == "mark" and last.text not in ("++", "--")


class _Lexer:
    def __init__(self, text: str, rules: Rules):
        self.text, self.name = text, rules.name
        self.scan = _scanner(rules.name, rules.line_comments, rules.block_comments, rules.quotes, rules.long_quotes)
        self.blocks = rules.block_comments
        self.out: list[Token] = []
        self.at = 0
        #: Tags of documents that begin on the next line.
        self.waiting: list[str] = []
        #: What is open: ``tag``, ``text`` between tags, ``{`` within either; ``case`` and ``(`` of a shell.
        self.modes: list[str] = []

    def add(self, kind: str, end: int, broken: bool = False) -> None:
        self.out.append(Token(kind, self.text[self.at : end], self.at, end, broken))
        self.at = end

    def run(self) -> list[Token]:
        if self.name == "php" and (m := re.compile(r".*?<\?(?:php\b|=)?", re.S).match(self.text)):
            self.add("string", m.end())
        while True:
            if self.modes and self.modes[-1] == "text":
                if not self.between_tags():
                    return self.out
                continue
            m = self.scan.search(self.text, self.at)
            if m is None:
                return self.out
            self.at = m.start()
            kind, special = (m.lastgroup.split("_")[0], True) if "_" in m.lastgroup else (m.lastgroup, False)
            if kind == "mark" and m[0][0] == "/" and self.name in _REGEX and "tag" not in self.modes[-1:] and _wants_value(self.out) and (r := _PATTERN.match(self.text, self.at)):
                self.add("string", r.end())
            elif kind == "heredoc":
                self.waiting.append(re.search(r"\w+", m[0])[0])
                self.add("string", m.end())
            elif kind == "newline" and self.waiting:
                self.documents()
            elif self.name in _TAGS and kind in ("mark", "open", "close") and self.tagged(kind, m):
                pass
            elif self.name == "bash" and self.shelled(kind, m):
                pass
            else:
                self.add(kind, m.end(), not special and self.is_broken(kind, m[0]))

    def is_broken(self, kind: str, text: str) -> bool:
        if kind == "string":
            return len(text) < 2 or text[-1] != text[0]
        return kind == "comment" and any(text.startswith(a) and not (text.endswith(b) and len(text) >= len(a) + len(b)) for a, b in self.blocks)

    def documents(self) -> None:
        """The documents of the tags on this line, up to the lines that hold their tags alone."""
        for tag in self.waiting:
            m = re.compile(rf"\n[ \t]*{tag}\b").search(self.text, self.at)
            self.add("string", m.end() if m else len(self.text), m is None)
        self.waiting.clear()

    def shelled(self, kind: str, m: re.Match) -> bool:
        """In a case a closing bracket without an opening one ends a label."""
        if kind == "word" and m[0] in ("case", "esac"):
            if m[0] == "case":
                self.modes.append("case")
            elif "case" in self.modes:
                del self.modes[len(self.modes) - 1 - self.modes[::-1].index("case") :]
        elif m[0] == "(":
            self.modes.append("(")
        elif m[0] == ")" and self.modes:
            if self.modes[-1] == "case":
                self.add("mark", m.end())
                return True
            self.modes.pop()
        return False

    def tagged(self, kind: str, m: re.Match) -> bool:
        """Tags among expressions: the state after this token; whether it is added here."""
        mode = self.modes[-1] if self.modes else ""
        if kind == "open" and m[0] == "{" and mode:
            self.modes.append("{")
        elif kind == "close" and m[0] == "}" and mode == "{":
            self.modes.pop()
        elif mode == "tag" and m[0][0] == ">":
            closed = self.out[-1].text == "/"
            self.add("mark", self.at + 1)
            self.modes.pop()
            if not closed:
                self.modes.append("text")
            return True
        elif mode != "tag" and m[0][0] == "<" and _OPENING_TAG.match(self.text, self.at) and _wants_value(self.out) and self.closes(m.start()):
            self.add("mark", self.at + 1)
            self.modes.append("tag")
            return True
        return False

    def closes(self, at: int) -> bool:
        """Whether a tag is closed anywhere behind; else the sign compares, or holds types."""
        name = re.compile(r"<([\w.]*)").match(self.text, at)[1]
        return f"</{name}" in self.text[at:] or re.compile(r"<[\w.]+(?:[^<>{}]|\{[^{}]*\})*/>", re.S).match(self.text, at) is not None

    def between_tags(self) -> bool:
        m = re.compile(r"[<{]").search(self.text, self.at)
        end = m.start() if m else len(self.text)
        lead = len(self.text[self.at : end]) - len(self.text[self.at : end].lstrip())
        words = self.text[self.at : end].strip()
        self.at += lead
        if words:
            self.add("string", self.at + len(words), m is None)
        self.at = end
        if m is None:
            return False
        if m[0] == "{":
            self.add("open", end + 1)
            self.modes.append("{")
        elif self.text.startswith("</", end):
            last = self.text.find(">", end)
            self.add("mark", last + 1 if last >= 0 else len(self.text))
            self.modes.pop()
        else:
            self.add("mark", end + 1)
            self.modes.append("tag")
        return True


@lru_cache(maxsize=64)
def _groups(scan: re.Pattern) -> dict[str, tuple[str, bool]]:
    """What the groups of a scanner find, and whether it is a form of its language."""
    return {g: (g.split("_")[0], "_" in g) for g in scan.groupindex}


def _stateless(text: str, rules: Rules) -> list[Token] | None:
    """The tokens of a text in which none depends on what came before it; none if one may."""
    lexer = _Lexer(text, rules)
    if rules.name == "php" and "<?" in text or rules.name in _TAGS and "<" in text or rules.name == "bash" and "case" in text:
        return None
    slashes, groups, is_broken = rules.name in _REGEX, _groups(lexer.scan), lexer.is_broken
    out = []
    for m in lexer.scan.finditer(text):
        kind, special = groups[m.lastgroup]
        found = m[0]
        start, end = m.span()
        if kind == "heredoc" or slashes and kind == "mark" and found[0] == "/":
            return None
        out.append(Token(kind, found, start, end, not special and kind in ("string", "comment") and is_broken(kind, found)))
    return out


def tokens(text: str, rules: Rules) -> list[Token]:
    found = _stateless(text, rules)
    return _Lexer(text, rules).run() if found is None else found
