"""Similarity of merchant keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_FLOOR, EDIT_FLOOR, MIN_FUZZY_CHARS = 0.80, 0.90, 4
TOKEN_LOW, TOKEN_HIGH, EDIT_CEILING, AUTO_APPLY = 0.60, 0.85, 0.60, 0.85


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts by the sum of the larger ones, over all tokens of two arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    zero = F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))
    sums = F.aggregate(F.array_union(a, b), zero, lambda s, t: F.struct((s["low"] + F.least(count(a, t), count(b, t))).alias("low"), (s["high"] + F.greatest(count(a, t), count(b, t))).alias("high")))
    return F.when(sums["high"] > 0, sums["low"] / sums["high"].cast("double")).otherwise(0.0)


def token_confidence(jaccard: Column) -> Column:
    """Linear from TOKEN_LOW at the floor to TOKEN_HIGH at 1."""
    return TOKEN_LOW + (TOKEN_HIGH - TOKEN_LOW) * (jaccard - TOKEN_FLOOR) / (1 - TOKEN_FLOOR)


def osa_distance(a: str, b: str) -> int:
    """Edits between UTF-16 units, with swaps of neighbours, no unit edited twice."""
    x, y = (list(memoryview(s.encode("utf-16-le", "surrogatepass")).cast("H")) for s in (a, b))
    two, one = [], list(range(len(y) + 1))
    for i, cx in enumerate(x, 1):
        row = [i]
        for j, cy in enumerate(y, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (cx != cy))
            if i > 1 and j > 1 and cx == y[j - 2] and x[i - 2] == cy:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length. Built-in Levenshtein counts a swap as two edits, hence a pandas UDF."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        units = lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2
        for xs, ys in batches:
            yield pd.Series([None if x is None or y is None else 1.0 if x == y else 1 - osa_distance(x, y) / max(units(x), units(y), 1) for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return ratio(a, b)
