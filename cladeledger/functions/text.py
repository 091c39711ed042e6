"""Small text helpers shared by the column functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The part before the last slash, or ``.`` for a bare name."""
    return F.when(
        F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    ).otherwise(F.lit("."))


def suffix(path: Column) -> Column:
    """The last extension with its dot, or an empty string."""
    return F.regexp_extract(basename(path), r".(\.[^.]+)$", 1)


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def literal_alternation(words: Iterable[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(literal_alternation(words))


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
