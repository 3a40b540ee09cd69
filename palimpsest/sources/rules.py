"""Languages: how their names are told, how their texts are cut, and what becomes of their raw nodes.

The tables are written for the builders of this package; node types are ours.
A rule set can be replaced or extended by an argument wherever one is used.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Everything that differs between languages."""

    name: str
    extensions: tuple[str, ...]
    #: How blocks are told: ``brace``, ``indent``, ``end``, ``keys`` (indented keys), ``tables``, or a parser of its own.
    style: str = "brace"
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    #: Quotes that may hold line ends.
    long_quotes: tuple[str, ...] = ()
    #: Whether a line end may end a statement.
    newline_ends: bool = False
    #: Words that open a named declaration, and its type.
    declarations: dict[str, str] = field(default_factory=dict)
    #: Further types that have names.
    named: frozenset[str] = frozenset()
    keywords: frozenset[str] = frozenset()
    #: Words that open a block that the word ``end`` closes.
    openers: frozenset[str] = frozenset()
    # What becomes of raw nodes.
    ignored: frozenset[str] = frozenset({"comment", ",", ";"})
    aliased: dict[str, str] = field(default_factory=dict)
    label_ignored: frozenset[str] = frozenset()
    flattened: frozenset[str] = frozenset()
    scaffolding: frozenset[str] = frozenset({"block", "statement", "parenthesized"})
    identifiers: frozenset[str] = frozenset({"name", "identifier"})
    blocks: frozenset[str] = frozenset({"block"})
    pairs: frozenset[str] = frozenset({"pair"})
    unordered: frozenset[str] = frozenset({"object"})
    comments: frozenset[str] = frozenset({"comment"})
    #: Types that may match each other.
    equivalent: tuple[frozenset[str], ...] = ()

    def is_ignored(self, kind: str, text: str) -> bool:
        return kind in self.ignored or text in self.ignored

    def alias(self, kind: str, text: str) -> str:
        """The text is looked up before the type."""
        return self.aliased.get(text) or self.aliased.get(kind) or kind

    def is_keyword(self, kind: str, text: str) -> bool:
        return kind in self.keywords or text in self.keywords

    def is_declaration(self, kind: str) -> bool:
        return kind in self.declaration_types

    @cached_property
    def declaration_types(self) -> frozenset[str]:
        return frozenset(self.declarations.values()) | self.named | {"function_definition"}

    def same_type(self, a: str, b: str) -> bool:
        return a == b or any(a in group and b in group for group in self.equivalent)


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_C = "break case continue default do else for goto if return switch while const static extern sizeof volatile inline typedef"
_OOP = _C + " catch class finally new private protected public this throw throws try abstract final super implements extends instanceof"
_SCALARS = (frozenset({"string", "number", "boolean", "scalar", "null"}),)

LANGUAGES: dict[str, Rules] = {
    r.name: r
    for r in (
        Rules("c", ("c", "h"), declarations={"struct": "struct_declaration", "enum": "enum_declaration", "union": "union_declaration"}, keywords=_words(_C + " struct enum union")),
        Rules("cpp", ("cpp", "cc", "cxx", "hpp", "hh"), declarations={"class": "class_declaration", "struct": "struct_declaration", "enum": "enum_declaration", "namespace": "namespace_declaration"}, keywords=_words(_OOP + " struct enum namespace template using virtual operator constexpr")),
        Rules("csharp", ("cs",), declarations={"class": "class_declaration", "struct": "struct_declaration", "enum": "enum_declaration", "interface": "interface_declaration", "namespace": "namespace_declaration"}, keywords=_words(_OOP + " struct enum interface namespace using var async await")),
        Rules("java", ("java",), declarations={"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}, keywords=_words(_OOP + " interface enum record package import")),
        Rules("go", ("go",), quotes="\"'`", long_quotes=("`",), newline_ends=True, declarations={"func": "function_declaration", "type": "type_declaration", "var": "var_declaration", "const": "const_declaration"}, keywords=_words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")),
        Rules("rust", ("rs",), quotes="\"", declarations={"fn": "function_declaration", "struct": "struct_declaration", "enum": "enum_declaration", "trait": "trait_declaration", "impl": "impl_declaration", "mod": "module_declaration"}, keywords=_words("as break const continue crate else enum fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while")),
        Rules("zig", ("zig",), block_comments=(), declarations={"fn": "function_declaration", "const": "const_declaration", "var": "var_declaration", "test": "test_declaration"}, keywords=_words("break catch comptime const continue defer else enum errdefer export extern fn for if inline pub return struct switch test try union unreachable usingnamespace var while")),
        Rules("javascript", ("js", "jsx", "mjs", "cjs"), quotes="\"'`", long_quotes=("`",), newline_ends=True, declarations={"function": "function_declaration", "class": "class_declaration"}, keywords=_words("async await break case catch class const continue default delete do else export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield")),
        Rules("php", ("php",), line_comments=("//", "#"), declarations={"function": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "trait": "trait_declaration"}, keywords=_words(_OOP + " echo foreach function interface namespace trait use as elseif")),
        Rules("css", ("css",), line_comments=(), declarations={}, keywords=_words("@media @import @font-face @keyframes @supports !important"), unordered=frozenset(), named=_words("rule"), identifiers=_words("selector")),
        Rules("python", ("py", "pyi"), style="indent", line_comments=("#",), block_comments=(), long_quotes=('"""', "'''"), newline_ends=True, declarations={"def": "function_declaration", "class": "class_declaration"}, keywords=_words("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")),
        Rules("bash", ("sh", "bash"), line_comments=("#",), block_comments=(), newline_ends=True, keywords=_words("if then else elif fi for in do done case esac while until function return")),
        Rules("lua", ("lua",), style="end", line_comments=("--",), block_comments=(("--[[", "]]"),), newline_ends=True, declarations={"function": "function_declaration"}, openers=_words("function do then"), keywords=_words("and break do else elseif end for function goto if in local not or repeat return then until while")),
        Rules("ruby", ("rb",), style="end", line_comments=("#",), block_comments=(), newline_ends=True, declarations={"def": "function_declaration", "class": "class_declaration", "module": "module_declaration"}, openers=_words("def class module if unless while until case begin do for"), keywords=_words("alias and begin break case class def do else elsif end ensure for if in module next nil not or redo rescue retry return self super then undef unless until when while yield")),
        Rules("yaml", ("yaml", "yml"), style="keys", line_comments=("#",), block_comments=(), equivalent=_SCALARS, unordered=_words("mapping")),
        Rules("toml", ("toml",), style="tables", line_comments=("#",), block_comments=(), long_quotes=('"""', "'''"), newline_ends=True, equivalent=_SCALARS, pairs=_words("pair table"), unordered=_words("table object document")),
        Rules("json", ("json",), style="json", line_comments=(), block_comments=()),
        Rules("html", ("html", "htm"), style="html", line_comments=(), block_comments=(("<!--", "-->"),), unordered=_words("attributes"), pairs=_words("attribute")),
    )
}
LANGUAGES["typescript"] = replace(LANGUAGES["javascript"], name="typescript", extensions=("ts",), declarations={**LANGUAGES["javascript"].declarations, "interface": "interface_declaration", "type": "type_declaration", "enum": "enum_declaration", "namespace": "namespace_declaration"})
LANGUAGES["tsx"] = replace(LANGUAGES["typescript"], name="tsx", extensions=("tsx",))

BY_EXTENSION = {e: r.name for r in LANGUAGES.values() for e in r.extensions}


def detect(name: str | None) -> str | None:
    """Language of a file by the last part of its base name."""
    base = (name or "").replace("\\", "/").rpartition("/")[2]
    return BY_EXTENSION.get(base.rpartition(".")[2].lower()) if "." in base else None


def language_of(name: str | Column) -> Column:
    """:func:`detect` as a column; null where the language is not known."""
    column = F.col(name) if isinstance(name, str) else name
    base = F.regexp_extract(column, r"[^/\\]*$", 0)
    known = F.create_map(*(F.lit(x) for pair in sorted(BY_EXTENSION.items()) for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1)))


def rule_table(spark: SparkSession, languages: Iterable[Rules] = LANGUAGES.values()) -> DataFrame:
    """All rules as rows (lang, kind, key, value): a small table to join with."""
    rows = []
    for r in languages:
        for kind in ("keywords", "ignored", "label_ignored", "flattened", "scaffolding", "identifiers", "blocks", "pairs", "unordered", "comments"):
            rows += [(r.name, kind, key, None) for key in sorted(getattr(r, kind))]
        rows += [(r.name, "declarations", key, None) for key in sorted(r.declaration_types)]
        rows += [(r.name, "aliased", key, value) for key, value in sorted(r.aliased.items())]
        rows += [(r.name, "equivalent", key, str(k)) for k, group in enumerate(r.equivalent) for key in sorted(group)]
    return spark.createDataFrame(rows, "lang string, kind string, key string, value string")
