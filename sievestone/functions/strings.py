"""String comparison: edit distance, common substrings and subsequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: Column, b: Column, threshold: int | None = None) -> Column:
    """Levenshtein distance; beyond a threshold -1."""
    return F.levenshtein(a, b) if threshold is None else F.levenshtein(a, b, threshold)


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, by a bit vector over the letters of a."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        where: dict[str, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for c in y:
            u = v & where.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return len(x) - v.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring: runs along diagonals, a row of the table at a time."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        if len(x) > len(y):
            x, y = y, x
        letters = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), "<u4")
        runs, best = np.zeros(len(y) + 1, np.int32), 0
        for c in x:
            runs[1:] = np.where(letters == ord(c), runs[:-1] + 1, 0)
            best = max(best, int(runs.max()))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")
