import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diff as P
from palimpsest.operators import viewer as V
from palimpsest.operators.lines import line_offsets
from palimpsest.plans import queries as Q
from palimpsest.sources import lexing, parsing
from palimpsest.sources.rules import LANGUAGES

PAIRS = [
    ("1", "a.py", "a.py", "def f(x):\n    # é\n    return 1\n\ndef g():\n    return h(2)\n", "def f(x):\n    return 3\n", False),
    ("2", "a.go", "a.go", "func (r *T) m() int {\n\treturn 1\n}\n", "func (r *T) m() int {\n\treturn 2\n", False),
    ("3", "a.json", "a.json", '{"a": 1}', '{"a": 2}', False),
    ("4", "a.txt", "b", "x\ny", "x", False),
    ("5", "a.js", "a.js", "a((", "b", True),
    ("6", "a.js", "a.ts", "f(1, /x/);\n", None, False),
]
KIND = P.PAIRS


@pytest.mark.parametrize("limit", [0, 1])
def test_modes_are_those_of_the_whole_comparison(spark, limit):
    pairs, options = spark.createDataFrame(PAIRS, KIND), P.Options(parse_error_limit=limit)
    found = P.modes(pairs, options).orderBy("pair_id").collect()
    assert found == P.diff(pairs, options).select("pair_id", "mode", "lang", "errors").orderBy("pair_id").collect()
    assert {r.mode for r in found} >= {"tree", "language", "conflict"}


def test_fields_of_actions_and_places_of_nodes(spark):
    pairs = spark.createDataFrame(PAIRS, KIND)
    whole, asked = P.actions(P.diff(pairs)), P.actions(P.diff(pairs, P.Options(actions=True, mappings=False, fields=("action", "node", "place"))))
    assert asked.columns == ["pair_id", "seq", "action", "node", "place"]
    assert sorted(asked.drop("place").collect()) == sorted(whole.select("pair_id", "seq", "action", "node").collect())
    side = F.when(F.col("node.tree") == "before", "left").otherwise("right")
    ends = asked.select("pair_id", "seq", side.alias("side"), "node.start_byte", "node.end_byte")
    lines = [line_offsets(pairs.select("pair_id", F.coalesce(c, F.lit("")).alias("text")), "pair_id").withColumn("side", F.lit(s)) for c, s in (("src", "left"), ("dst", "right"))]
    told = {(r.pair_id, r.seq): r.range for r in V.range_texts(ends, lines[0].unionByName(lines[1]), ["pair_id"]).collect()}
    assert told == {(r.pair_id, r.seq): f"L{r.place.start_line + 1}:{r.place.start_col + 1} - L{r.place.end_line + 1}:{r.place.end_col + 1}" for r in asked.collect()}


def test_declarations_of_texts_are_those_of_their_nodes(spark):
    texts = [*[(p[3], p[1]) for p in PAIRS[:2]], ("class A(B, c):\n  def m(self, (a)): pass\n(x) = 1\n", "a.py"), ("func (a B) (c D) e() {}\n", "a.go"), ("int (f)(x) { }", "a.c"), (".a { b: c; }", "a.css"), (None, "a.py")]
    rows = [(k, text, LANGUAGES[parsing.LANGUAGES[next(n for n, r in LANGUAGES.items() if name.split(".")[1] in r.extensions)].name].name) for k, (text, name) in enumerate(texts)]
    table = spark.createDataFrame(rows, "key long, text string, lang string")
    known = parsing.declarations(parsing.nodes(table)).select("key", "node_id", "type", "name", "receiver", "pre_size")
    assert sorted(parsing.declared(table).collect()) == sorted(known.collect())
    assert known.count() >= 6


def test_tokens_without_state_are_those_of_the_lexer():
    forms = ["a = b / c / d\n", "<a>{x}</a>", "cat <<EOF\nx\nEOF\n", "case x in a) b;; esac", "<?php echo 1; ?>", "f(\"x\\\"y\", 'z) /* q */ // r\n", "x = r\"a\" `b`"]
    for rules in LANGUAGES.values():
        if rules.style in ("json", "html"):
            continue
        for text in [*forms, *(entry.replace("%d", "7") for entry in Q.CODE.values())]:
            assert lexing.tokens(text, rules) == lexing._Lexer(text, rules).run()


def test_only_asked_work_is_done(monkeypatch):
    """Errors are told without a tree, and trees without a list of comments."""
    monkeypatch.setattr(parsing.code, "comments", None)
    assert len(parsing.bare("def f():\n    return 1\n", "python")) > 3
    monkeypatch.setattr(parsing.code, "normalized", None)
    assert parsing.errors_in("f((1)", "c") == 1
