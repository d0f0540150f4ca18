"""Lexical structure of SQL text: quotes, comments, bodies in dollars, statements and bracketed clauses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A quote closes at the first matching quote that no backslash precedes; an open quote runs on.
QUOTED = "|".join(rf"{q}[\s\S]*?(?:(?<!\\){q}|\z)" for q in ("'", '"', "`"))
COMMENT = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
# A body between two equal dollar tags; the tag is the second group of a pattern.
DOLLARS = r"(\$(?:[A-Za-z_]\w*)?\$)[\s\S]*?(?:\2|\z)"
_STATEMENT = rf"((?:[^;'\"`$]++|{QUOTED}|{DOLLARS}|\$)++)"
_TOKEN = rf"((?:[^'\"`$(),]++|{QUOTED}|{DOLLARS}|\$)++|[(),])"

# Stands for a string literal where only what is around it counts.
HOLE = "\u0001"
_LITERAL = r"'(?:[^']|'')*+(?:'|\z)"


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, rf"({QUOTED}|{DOLLARS})|{COMMENT}", "$1")


def stripped(texts: Column) -> Column:
    """The texts without white space around them, empty ones left out."""
    return F.filter(F.transform(texts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def statements(text: Column) -> Column:
    """Top-level statements in order, comments dropped."""
    return stripped(F.regexp_extract_all(without_comments(text), F.lit(_STATEMENT), F.lit(1)))


def clauses(text: Column) -> Column:
    """The comma-separated clauses of a text up to the bracket that closes it, or its end.

    Tokens come from one pass of a pattern; the depth of brackets runs along them, and a comma parts
    clauses at depth 0 alone.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def state(depth: Column, held: Column, out: Column) -> Column:
        return F.struct(depth.alias("depth"), held.alias("held"), out.alias("out"))

    def step(a: Column, token: Column) -> Column:
        depth, done = a["depth"], F.concat(a["out"], F.array(a["held"]))
        longer = F.concat(a["held"], token)
        return (
            F.when(depth < 0, a)
            .when(token == "(", state(depth + 1, longer, a["out"]))
            .when((token == ")") & (depth == 0), state(F.lit(-1), F.lit(""), done))
            .when(token == ")", state(depth - 1, longer, a["out"]))
            .when((token == ",") & (depth == 0), state(depth, F.lit(""), done))
            .otherwise(state(depth, longer, a["out"]))
        )

    return stripped(F.aggregate(tokens, start, step, lambda a: F.concat(a["out"], F.array(a["held"]))))


def literals(text: Column) -> Column:
    """String literals of a text, in order."""
    return F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0))


def hollow(text: Column) -> Column:
    """The text with a hole in place of each string literal."""
    return F.regexp_replace(text, _LITERAL, HOLE)


def holes(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(HOLE), F.lit("")))


def filled(part: Column, before: Column, values: Column) -> Column:
    """A part of a hollow text with its literals: those after the ones of the text ``before`` it."""
    texts = F.split(part, HOLE)
    mine = F.slice(F.concat(values, F.array(F.lit(""))), holes(before) + 1, F.size(texts) - 1)
    return F.array_join(F.zip_with(texts, F.concat(mine, F.array(F.lit(""))), lambda t, v: F.concat(t, v)), "")
