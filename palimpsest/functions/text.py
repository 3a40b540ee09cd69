"""String functions of the diff engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
TRIVIAL_BRACKETS = ("{", "}", "(", ")", "[", "]", "};", ");", "})", "});", "()", "{}", "() {")
TRIVIAL_ANCHORS = ("*", "/**", "/*", "*/", "//", "<p>", "</p>")
SIZE_LIMIT = 400 * 1024
#: Labels that open or close a group.
BRACKETS = ("(", ")", "[", "]", "{", "}")
#: Unicode white space, which both ends of a text are trimmed of.
_SPACE = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def is_trivial_line(line: Column) -> Column:
    """A line of brackets alone."""
    return trimmed(line).isin(*TRIVIAL_BRACKETS)


def is_trivial_anchor(line: Column) -> Column:
    """A line that opens or closes a comment or paragraph and says nothing else."""
    return trimmed(line).isin(*TRIVIAL_ANCHORS)


def has_word(text: Column) -> Column:
    return text.rlike("[A-Za-z0-9_]")


def unquote(text: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(text, r"^(?s)(?:\"(.*)\"|'(.*)'|`(.*)`)$", "$1$2$3")


def clean_comment(text: Column) -> Column:
    """Lower case, without comment marks and white space at both ends."""
    return F.btrim(F.lower(text), F.lit("/#* \t\r\n"))


def has_conflict(text: Column) -> Column:
    """Merge conflict markers at the start of a line."""
    opens = text.startswith("<<<<<<<") | text.contains("\n<<<<<<<")
    return opens & (text.contains("\n>>>>>>>") | text.contains(">>>>>>>\n"))


def is_binary(text: Column, within: int = 8000) -> Column:
    """A zero byte among the first bytes."""
    return F.hex(F.substring(text.cast("binary"), 1, within)).rlike("^(?:..)*?00")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length, in code points; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def is_plain(content: Column) -> Column:
    """Whether bytes are a text: valid UTF-8 without a NUL among the first 8,000 bytes."""
    return F.try_validate_utf8(content.cast("string")).isNotNull() & ~is_binary(F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit("")))


def as_text(content: Column) -> Column:
    """Bytes as a text, whatever they are: UTF-8 if they are valid, else one character for each byte."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
