"""Tokens, sizes and small text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEXICAL = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\s]"
DENSE = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
# Words that no question is about.
STOP = ("the", "and", "for", "with", "from", "this", "that", "into", "main", "note", "list", "call", "find", "out", "key")
WORD = r"[A-Za-z][A-Za-z0-9_]{2,}"
QUERY_TOKEN = r"[A-Za-z0-9_./+-]+"


def lexical_tokens(text: Column) -> Column:
    """Words, numbers and single marks; lower case after matching."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEXICAL), F.lit(0)), F.lower)


def dense_tokens(text: Column) -> Column:
    """Words and numbers; lower case before matching."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(DENSE), F.lit(0))


def n_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def keywords(text: Column, most: int = 6) -> Column:
    """The first distinct words of three characters or more that aren't stop words, as they are written."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP))
    return F.slice(F.array_distinct(words), 1, most)


def short_query(text: Column, most: int = 8, chars: int = 64) -> Column:
    """The first tokens, without white space at the end where it is cut."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUERY_TOKEN), F.lit(0))
    clipped = F.array_join(F.slice(tokens, 1, most), " ")
    return F.when(F.length(clipped) > chars, F.rtrim(F.substring(clipped, 1, chars))).otherwise(clipped)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), of), 1)


def joined_query(parts: Column, chars: int = 220) -> Column:
    """Distinct parts in order, up to the first that doesn't fit."""
    distinct = F.array_distinct(F.filter(F.transform(parts, stripped), lambda p: p != ""))
    state = lambda query, length: F.struct(query.alias("query"), length.alias("length"))

    def add(a: Column, p: Column) -> Column:
        length = a["length"] + 1 + F.length(p)
        # A part that doesn't fit closes the query: its length leaves no room for another.
        return F.when(length > chars, state(a["query"], F.lit(chars))).otherwise(state(F.when(a["length"] < 0, p).otherwise(F.concat(a["query"], F.lit(" "), p)), length))

    return F.aggregate(distinct, state(F.lit(""), F.lit(-1)), add, lambda a: a["query"])


def clipped(text: Column, chars: int) -> Column:
    """White space as single spaces; cut, and then without a space at the end."""
    return F.rtrim(F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, chars))


def names(text: Column, most: int) -> Column:
    """The first names of three letters or more."""
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), 1, most)


def guessed_symbols(text: Column, most: int = 3) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?:def|class|function)\s+([A-Za-z_]\w*)"), F.lit(1))
    return F.slice(found, 1, most)


def has_symbol(symbol: Column, code: Column) -> Column:
    """Whether the symbol, its class or its member stands in the code as a whole word."""
    words = F.regexp_extract_all(code, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    parts = F.array_distinct(F.split(symbol, r"\."))
    return F.exists(parts, lambda p: (p != "") & F.array_contains(words, p))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_range(text: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")
