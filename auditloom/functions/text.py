"""String helpers that follow Python's text conventions where they differ from Spark's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Universal newlines of a text file, and the wider set str.splitlines() breaks on.
FILE_BREAK = r"\r\n|\r|\n"
TEXT_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def contains_any(text: Column, needles: list[str]) -> Column:
    return any_of([text.contains(n) for n in needles])


def first_contained(text: Column, needles: list[str]) -> Column:
    """First needle, in list order, that occurs in ``text``; NULL when none does."""
    return F.coalesce(*[F.when(text.contains(n), F.lit(n)) for n in needles])


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def text_lines(text: Column) -> Column:
    """Lines of ``text`` without terminators; no trailing empty line."""
    pieces = F.split(text, TEXT_BREAK, -1)
    return F.when(
        F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ).otherwise(pieces)


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def json_quote(text: Column) -> Column:
    """``text`` as an ASCII-only JSON string literal."""
    plain = text
    for raw, escaped in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        plain = F.replace(plain, F.lit(raw), F.lit(escaped))

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(char: Column) -> Column:
        code = F.ascii(char)
        astral = code - F.lit(0x10000)
        high = F.lit(0xD800) + F.shiftright(astral, 10)
        low = F.lit(0xDC00) + astral.bitwiseAND(F.lit(0x3FF))
        return (
            F.when(char == "\\", "\\\\")
            .when(char == '"', '\\"')
            .when(char == "\n", "\\n")
            .when(char == "\r", "\\r")
            .when(char == "\t", "\\t")
            .when(char == "\b", "\\b")
            .when(char == "\f", "\\f")
            .when((code >= 32) & (code <= 126), char)
            .when(code < 0x10000, unit(code))
            .otherwise(F.concat(unit(high), unit(low)))
        )

    spelled = F.array_join(F.transform(F.split(text, ""), escape), "")
    body = F.when(text.rlike(r"^[ -~\n\r\t]*$"), plain).otherwise(spelled)
    return F.concat(F.lit('"'), body, F.lit('"'))
