"""Similarities between strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_WEIGHT = 0.1
PREFIX_MOST = 4


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def character_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct characters; 1 for two empty strings."""

    def letters(x: Column) -> Column:
        return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(x, "")))

    union = F.size(F.array_union(letters(a), letters(b)))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(letters(a), letters(b))) / union)


def jaro_winkler(a: str | None, b: str | None, strict: bool = True) -> float | None:
    """Jaro-Winkler whose prefix term counts equal places of the whole overlap, four at most.

    The match window of two single characters is below 0, so that they never match; with
    strict=False equal strings are 1.
    """
    if a is None or b is None:
        return None
    if not strict and a == b:
        return 1.0
    window = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(i + window + 1, len(b))):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = min(PREFIX_MOST, sum(x == y for x, y in zip(a, b, strict=False)))
    return jaro + PREFIX_WEIGHT * same * (1 - jaro)


def jaro_winkler_similarity(a, b, strict: bool = True) -> Column:
    """jaro_winkler() of two columns; meant for distinct pairs, as it leaves the JVM."""

    def pairs(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(*p, strict=strict) for p in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(pairs, "double")(a, b)
