"""Text helpers made of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(items: Column, n: int) -> Column:
    """Every n neighbours of an array, joined by single spaces; empty for shorter arrays."""
    last = F.size(items) - n + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def initials(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.upper(F.substring(w, 1, 1))), "")
