"""Personal data: patterns propose, checksums confirm, context adjusts (native).

Every kind has a pattern, a validator over the matched text and a base score.
Words in the ``CONTEXT`` code points before a span raise the score.  Spans that
reach ``threshold`` are reported; the checked kinds email, ip, card and phone
reach it by themselves, iban by its mod-97 check, and social security numbers
only with a context word.

Positions are code points, end exclusive.  A document is split by the pattern
only where the pattern occurs, and the lengths of the pieces give the
positions, so all work stays in the JVM.

Cases: null text counts as empty and has no spans, and stays null when redacted;
repeated rows are independent; spans of different kinds may overlap, and
redaction merges them, of equal starts the shorter first; very long texts cost
in proportion to their length and, nearly, to their matches; further columns of
any name come back as they are, but for one named as the result; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span in which context words count.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """``needs`` is a cheap test that must hold before the pattern runs; ``valid`` is SQL over ``v``, the match."""

    name: str
    pattern: str
    needs: str
    valid: str
    score: float
    context: str


_DIGITS = "regexp_replace(v, '[^0-9]', '')"
# Moves four characters to the end, letters count 10 to 35, remainder by 97 digit by digit.
_IBAN = "regexp_replace(v, ' ', '')"
_MOD97 = f"""aggregate(split(concat(substring({_IBAN}, 5), substring({_IBAN}, 1, 4)), ''), 0,
    (r, c) -> CASE WHEN c = '' THEN r WHEN c >= 'A' THEN (r * 100 + ascii(c) - 55) % 97 ELSE (r * 10 + ascii(c) - 48) % 97 END) = 1"""

#: The base kinds come first, in the order of the digest.  Lookbehind and \\G
#: start a match where the plain pattern would, at the left end of a run or at
#: the end of the match before; possessive loops keep the scan linear.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", "true", 0.9, "mail|contact"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "contains({t}, '.')", r"v rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'", 0.6, "ip|host|server|addr"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "true", f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})", 0.8, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "{t} rlike '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ][A-Z0-9]{{3}}'", _MOD97, 0.9, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "{t} rlike '[0-9]-[0-9]{{2}}-[0-9]'", "NOT v rlike '^(000|666|9)|-00-|-0000$'", 0.3, "ssn|social|security"),
)
BASE = tuple(k.name for k in KINDS[:4])
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,v:string>>"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else repr(pattern)


#: Lengths that are added up in one run.
_BLOCK = 256


def _before(lengths: str) -> str:
    """SQL for the sums of all earlier numbers of an array, in blocks, so that the work does not grow with the square of its size."""
    def sums(array: str, first: str) -> str:
        return f"slice(aggregate({array}, array({first}), (a, x) -> concat(a, array(element_at(a, -1) + x))), 1, size({array}))"

    blocks = f"transform(sequence(0, (size({lengths}) - 1) div {_BLOCK}), k -> slice({lengths}, k * {_BLOCK} + 1, {_BLOCK}))"
    totals = f"transform({blocks}, b -> aggregate(b, 0L, (s, x) -> s + x))"
    return f"flatten(zip_with({blocks}, {sums(totals, '0L')}, (b, f) -> {sums('b', 'f')}))"


def _spans(kind: Kind, text: str) -> str:
    """SQL for the valid spans of one kind in column ``text``."""
    none, found, pieces = f"CAST(array() AS {_SPAN})", f"_found_{kind.name}", f"_pieces_{kind.name}"
    starts = _before(f"zip_with(slice({pieces}, 1, size({found})), {found}, (p, m) -> CAST(length(p) + length(m) AS BIGINT))")
    at = f"zip_with({starts}, slice({pieces}, 1, size({found})), (b, p) -> b + length(p))"
    walk = f"zip_with({at}, {found}, (b, m) -> named_struct('kind', '{kind.name}', 'start', b, 'end', b + length(m), 'score', {kind.score}D, 'v', m))"
    valid = kind.valid.replace("v,", "s.v,").replace("v rlike", "s.v rlike")
    before = f"lower(substring({text}, CAST(greatest(s.start - {CONTEXT}, 0) + 1 AS INT), CAST(least(s.start, {CONTEXT}) AS INT)))"
    scored = f"named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'score', least(1.0D, s.score + IF({before} rlike '{kind.context}', 0.3D, 0.0D)), 'v', s.v)"
    return f"IF(size({found}) = 0, {none}, transform(filter({walk}, s -> {valid}), s -> {scored}))"


def _found(df: DataFrame, text: str, threshold: float) -> DataFrame:
    """(_row, _t, _spans): the columns of ``df`` as one, its text, and the spans of all kinds."""
    t = "_t"
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias(t))
    for kind in KINDS:
        found = f"IF({kind.needs.format(t=t)}, regexp_extract_all({t}, {_sql(kind.pattern)}, 0), CAST(array() AS array<string>))"
        df = df.withColumn(f"_found_{kind.name}", F.expr(found))
    df = df.withColumns(
        {f"_pieces_{k.name}": F.expr(f"IF(size(_found_{k.name}) = 0, CAST(array() AS array<string>), split({t}, {_sql(k.pattern)}, -1))") for k in KINDS}
    )
    df = df.withColumns({f"_spans_{k.name}": F.expr(_spans(k, t)) for k in KINDS})
    every = F.concat(*(F.col(f"_spans_{k.name}") for k in KINDS))
    return df.select("_row", t, F.filter(every, lambda s: s["score"] >= F.lit(threshold)).alias("_spans"))


def find_spans(df: DataFrame, text: str = "text", out: str = "_spans", threshold: float = 0.5) -> DataFrame:
    """Adds ``out``: the spans of all kinds with their scores, by kind as listed, then start; a column of that name is replaced."""
    found = _found(df, text, threshold)
    return found.select(*(F.col(f"_row.`{c}`") for c in df.columns if c != out), F.col("_spans").alias(out))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``text`` with every span replaced by its kind in angle brackets; all columns stay.

    Overlapping spans become one, named after the one that starts first.
    """
    walk = F.expr(
        """array_join(aggregate(
            array_sort(transform(_spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
            named_struct('at', 0L, 'out', CAST(array() AS array<struct<from:bigint,to:bigint,kind:string>>)),
            (a, s) -> named_struct(
                'at', greatest(a.at, s.end),
                'out', IF(s.start >= a.at, concat(a.out, array(named_struct('from', a.at, 'to', s.start, 'kind', s.kind))), a.out)),
            a -> concat(transform(a.out, p -> concat(substring(_t, CAST(p.from + 1 AS INT), CAST(p.to - p.from AS INT)), '<', p.kind, '>')), array(substring(_t, CAST(a.at + 1 AS INT))))), '')"""
    )
    clean = F.when(F.size("_spans") > 0, walk).otherwise(F.col(f"_row.`{text}`"))
    found = _found(df, text, threshold)
    return found.select(*(clean.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns))
