"""From texts to trees and to tables of their nodes and comments."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import code, trees
from .rules import LANGUAGES, Rules
from .trees import Tree

#: Languages with a parser of their own.
OWN: dict[str, Callable[[str], Tree]] = {"json": trees.parse_json, "html": trees.parse_html}


def parse(text: str, lang: str, rules: Mapping[str, Rules] = LANGUAGES) -> Tree:
    """The normalized tree of a text with its comments; other rules than the usual ones may be given."""
    own = OWN.get(rules[lang].style)
    if own:
        return own(text)
    raw, errors = code.raw_tree(text, rules[lang])
    tree = code.normalized(text, raw, errors, rules[lang])
    tree.comments = code.comments(text, raw, rules[lang], tree)
    return tree


def bare(text: str, lang: str, rules: Mapping[str, Rules] = LANGUAGES) -> Tree:
    """The same tree, in which comments need not be listed."""
    own = OWN.get(rules[lang].style)
    return own(text) if own else code.normalized(text, *code.raw_tree(text, rules[lang]), rules[lang])


def errors_in(text: str, lang: str, rules: Mapping[str, Rules] = LANGUAGES) -> int:
    """The parse errors of a text, without its tree where the tree does not tell them."""
    own = OWN.get(rules[lang].style)
    return own(text).errors if own else code.raw_tree(text, rules[lang])[1]


NODES = """key long, node_id int, parent_id int, child_index int, depth int, height int, pre_size int, post_start int,
    type string, label string, start_byte int, end_byte int, start_row int, end_row int, is_keyword boolean, is_unordered boolean, h_full long, h_shape long, lang string"""


#: Nodes after which a batch ends.
BATCH_NODES = 5_000
#: Characters of a text whose nodes a task remembers, and how many such texts.
SHORT_TEXT = 200
KNOWN_TEXTS = 1_000


def _with_lang(texts: DataFrame, lang: str | None) -> DataFrame:
    """(key, text, lang); rows without a known language are left out."""
    if lang is not None:
        return texts.select("key", "text", F.lit(lang).alias("lang"))
    return texts.select("key", "text", "lang").where(F.col("lang").isin(*LANGUAGES))


def nodes(texts: DataFrame, lang: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for every node of ``texts`` (key, text), of one language or with a column ``lang``; null text is empty.

    With ``columns`` only those leave the tasks, in the order of ``NODES``.

    Each text is parsed on its own, so any partitioning of the input is fine
    and nothing is shuffled.  Nodes of many texts go out at once; a text is not cut.
    Short texts that repeat in a task are parsed once.
    """
    every = [c.split()[0] for c in NODES.replace("\n", " ").split(",")]
    wanted = [k for k, name in enumerate(every) if columns is None or name in columns]
    names = [every[k] for k in wanted]
    hashed = "h_full" in names or "h_shape" in names
    schema = ", ".join(NODES.replace("\n", " ").split(",")[k] for k in wanted)
    kinds = [pa.int64(), *[pa.int32()] * 7, pa.string(), pa.string(), *[pa.int32()] * 4, pa.bool_(), pa.bool_(), pa.uint64(), pa.uint64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in wanted]
        size = 0
        known: dict[tuple[str, str], tuple] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, kinds[k]) for c, k in zip(rows, wanted, strict=True)]
            for c in rows:
                c.clear()
            # Hashes keep their bits and become signed.
            return pa.RecordBatch.from_arrays([c.view(pa.int64()) if c.type == pa.uint64() else c for c in columns], names)

        for batch in batches:
            for key, text, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                made = known.get((text, name))
                if made is None:
                    t = bare(text, name)
                    n = len(t)
                    hashes = (t.full, t.shape) if hashed else (None, None)
                    made = (None, range(n), t.parent, t.place, t.depth, t.height, t.size, t.post_start, t.kind, t.label, t.start, t.end, t.row, t.end_row, t.keyword, t.unordered, *hashes, [name] * n)
                    if len(text) <= SHORT_TEXT:
                        if len(known) == KNOWN_TEXTS:
                            known.clear()
                        known[text, name] = made
                n = len(made[1])
                for column, k in zip(rows, wanted, strict=True):
                    column += made[k] if k else [key] * n
                size += n
                if size >= BATCH_NODES:
                    yield out()
                    size = 0
        if size:
            yield out()

    return _with_lang(texts, lang).mapInArrow(run, schema)


COMMENTS = "key long, idx int, text string, start_byte int, end_byte int, start_row int, end_row int, scope_key string, parent_type string"


def comment_blocks(texts: DataFrame, lang: str | None = None) -> DataFrame:
    """One row for every comment of ``texts`` (key, text), of one language or with a column ``lang``, in order."""
    names = [c.split()[0] for c in COMMENTS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k in range(batch.num_rows):
                found = parse(batch.column(1)[k].as_py() or "", batch.column(2)[k].as_py()).comments
                keys += [k] * len(found)
                rows += [(i, c.text, c.start, c.end, c.row, c.end_row, c.scope, c.parent_kind) for i, c in enumerate(found)]
            kinds = [pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return _with_lang(texts, lang).mapInArrow(run, COMMENTS)


def declarations(table: DataFrame, languages: Mapping[str, Rules] = LANGUAGES) -> DataFrame:
    """(key, node_id, type, name, receiver, pre_size): the named declarations of a table of :func:`nodes` with ``lang``, joined with their first name.

    The receiver is the last identifier in brackets before the name, where a declaration has one.
    """
    kinds = F.create_map(*(x for r in languages.values() for x in (F.lit(r.name), F.array(*map(F.lit, sorted(r.declaration_types))))))
    names = F.create_map(*(x for r in languages.values() for x in (F.lit(r.name), F.array(*map(F.lit, sorted(r.identifiers))))))
    own = table.where(F.array_contains(F.try_element_at(kinds, F.col("lang")), F.col("type"))).select("key", "lang", "node_id", "type", "pre_size")
    child = table.where(F.array_contains(F.try_element_at(names, F.col("lang")), F.col("type")) & (F.col("label") != "")).select(
        "key", F.col("parent_id").alias("node_id"), F.col("node_id").alias("_c"), "label", (F.col("type") != "name").alias("_later")
    )
    first = child.groupBy("key", "node_id").agg(F.min(F.struct("_later", "_c", "label")).alias("n"))
    named = own.join(first, ["key", "node_id"]).select("key", "node_id", "type", "pre_size", F.col("n.label").alias("name"), F.col("n._c").alias("_c"))
    groups = table.where("type = 'parenthesized'").select("key", F.col("parent_id").alias("node_id"), F.col("node_id").alias("_g"), F.col("pre_size").alias("_n"))
    front = named.join(groups, ["key", "node_id"]).where("_g < _c").groupBy("key", "node_id").agg(F.min(F.struct("_g", "_n")).alias("g"))
    leaves = table.where("type = 'identifier'").select("key", F.col("node_id").alias("_i"), "label")
    inside = front.join(leaves, "key").where("_i > g._g AND _i < g._g + g._n").groupBy("key", "node_id").agg(F.max_by("label", "_i").alias("receiver"))
    return named.drop("_c").join(inside, ["key", "node_id"], "left").select("key", "node_id", "type", "name", F.coalesce("receiver", F.lit("")).alias("receiver"), "pre_size")


DECLARED = "key long, node_id int, type string, name string, receiver string, pre_size int"


def declared(texts: DataFrame, lang: str | None = None, rules: Mapping[str, Rules] = LANGUAGES) -> DataFrame:
    """What :func:`declarations` finds among the nodes of ``texts`` (key, text), where each tree is small enough for a task.

    One row leaves the tasks for each declaration, where a table of nodes has all that a text holds.
    """
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
    names = [c.split()[0] for c in DECLARED.split(", ")]

    def found(t: Tree, r: Rules) -> Iterator[tuple]:
        types, identifiers = r.declaration_types, r.identifiers
        for i, kind in enumerate(t.kind):
            if kind not in types:
                continue
            named = [c for c in t.children[i] if t.kind[c] in identifiers and t.label[c]]
            if not named:
                continue
            name = min(named, key=lambda c: (t.kind[c] != "name", c))
            front = next((c for c in t.children[i] if c < name and t.kind[c] == "parenthesized"), None)
            inside = () if front is None else range(front + t.size[front] - 1, front, -1)
            receiver = next((t.label[k] for k in inside if t.kind[k] == "identifier"), "")
            yield i, kind, t.label[name], receiver, t.size[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *row) for key, text, name in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in found(bare(text or "", name, rules), rules[name])]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _with_lang(texts, lang).mapInArrow(run, DECLARED)
