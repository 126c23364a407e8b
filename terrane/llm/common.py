"""Shared pieces of the text operators: word splitting and bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of every contract: space and tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let value in body``: the optimizer can't inline a lambda's argument, so it is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
