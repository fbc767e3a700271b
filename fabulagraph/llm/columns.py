"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII white space that parts words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACES_RE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES_RE), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")
