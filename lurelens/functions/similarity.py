"""Edit distances and similarities of short strings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import UNKNOWN
from .udf import vectorized


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        held = row & places.get(c, 0)
        row = (row + held | row - held) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * common subsequence / total length; 0 if either is empty."""
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


@vectorized("double")
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(left.fillna(""), right.fillna(""), strict=True):
            if pair not in known:
                known[pair] = indel_ratio(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """The Indel ratio of two columns."""
    return _ratio(a, b)


def similarity_native(a: Column, b: Column) -> Column:
    """The same without Python, by a fold over both strings; slower, for plans that must stay in the JVM."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    start = F.transform(F.concat(F.array(F.lit("")), chars(b)), lambda _: F.lit(0))

    def row(previous: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            up, left, corner = F.get(previous, j), F.element_at(done, -1), F.get(previous, j - 1)
            return F.concat(done, F.array(F.when(F.substr(b, j, F.lit(1)) == c, corner + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    length = F.element_at(F.aggregate(chars(a), start, row), -1)
    empty = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(2.0 * length / (F.length(a) + F.length(b)))


def fallback_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length."""
    empty = (a == "") | (b == "")
    return F.when(empty, F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def min_window_distance(text: Column, needle: Column) -> Column:
    """Least edit distance of ``needle`` to the windows of its length in ``text``; -1 if either is empty."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(needle) + 1, F.lit(1)))
    windows = F.array_min(F.transform(places, lambda i: F.levenshtein(F.substr(text, i, F.length(needle)), needle)))
    return (
        F.when((text == "") | (needle == ""), F.lit(UNKNOWN))
        .when(text.contains(needle), F.lit(0))
        .when(F.length(text) <= F.length(needle), F.levenshtein(text, needle))
        .otherwise(windows)
    )
