"""Column expressions on text that several operators of this subpackage share (JVM side only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: The blanks that end a word, and the letters that lower-casing touches.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column that is used inside a lambda may be inlined there by the optimizer and then
    runs once per element; a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def count_of(text: Column, letters: str) -> Column:
    """How many characters of a text are one of ``letters``."""
    return (F.length(text) - F.length(without(text, letters))).cast("long")


def indices(first: int, last: Column) -> Column:
    """``first .. last``, empty if last < first."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
