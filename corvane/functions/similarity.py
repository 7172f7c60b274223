"""Similarities of texts and token arrays."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import bind


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def levenshtein(a: Column, b: Column) -> Column:
    """1 less the edits over the longer length; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(bind(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller array; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def contains_other(a: Column, b: Column) -> Column:
    return flag((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)))


def unless_missing(a: Column, b: Column) -> Column:
    """One half if either is empty, else whether they are equal."""
    return F.when((a == "") | (b == ""), 0.5).otherwise(flag(a == b))


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    return 2 * subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def sorted_ratio(a: str, b: str) -> float:
    """Indel similarity of two texts of sorted words."""
    return indel(a, b) if a and b else 0.0


def set_ratio(both: str, only_a: str, only_b: str) -> float:
    """Best indel similarity among the shared words and the shared words with either rest (neither is empty).

    Where words are shared they and a space lead both texts, so only the rests
    have to be compared.
    """
    n = len(both)
    lead = n + 1 if n else 0
    a, b = lead + len(only_a), lead + len(only_b)
    best = 2 * (lead + subsequence(only_a, only_b)) / (a + b)
    return max(best, 2 * n / (n + a), 2 * n / (n + b)) if n else best


def _arrow(measure: Callable[..., float]):
    @F.arrow_udf(T.DoubleType())
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else measure(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    @F.arrow_udf(T.DoubleType())
    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else measure(x, y, z) for x, y, z in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)], pa.float64())

    return two, three


#: Arrow functions, since Spark has no common-subsequence measure; only pairs that expressions can't settle reach them.
_sorted_ratio, _set_ratio = _arrow(sorted_ratio)[0], _arrow(set_ratio)[1]


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel similarity of two texts of sorted words; 0 if either is empty."""
    settled = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
    return F.coalesce(settled, _sorted_ratio(F.when(settled.isNull(), a), b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Of two sorted arrays of distinct words: 0 if either is empty, 1 if one holds the other, else the best similarity."""
    both, only_a, only_b = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
    settled = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when((F.size(only_a) == 0) | (F.size(only_b) == 0), 1.0)
    return F.coalesce(settled, _set_ratio(F.when(settled.isNull(), F.array_join(both, " ")), F.array_join(only_a, " "), F.array_join(only_b, " ")))
