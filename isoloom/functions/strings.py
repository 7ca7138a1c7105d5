"""Tokenising, searching and small numeric helpers as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, separators: str) -> Column:
    """Non-empty pieces between any of the separator characters."""
    escaped = "".join("\\" + c if c in "\\]^-[" else c for c in separators)
    return F.filter(F.split(text, f"[{escaped}]"), lambda t: t != "")


def find(text: Column, pattern: Column, start: int = 0) -> Column:
    """0-based place of the first occurrence from ``start`` on, -1 if there is none."""
    at = F.instr(F.substr(text, F.lit(start + 1)), pattern)
    return F.when(at > 0, at - 1 + start).otherwise(-1)


def find_within(text: Column, pattern: Column, length: int) -> Column:
    """As ``find``, in the first ``length`` characters."""
    return F.instr(F.substring(text, 1, length), pattern) - 1


def count(text: Column, pattern: Column) -> Column:
    """Occurrences that don't overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, pattern, F.lit("")))) / F.length(pattern))


def middle(a: Column, b: Column) -> Column:
    """The mean of two integers, rounded down."""
    return F.floor((a + b) / 2)


def mixed(key: Column) -> Column:
    """A 64-bit hash of an integer key."""
    return F.xxhash64(key)
