"""Word segmentation for scripts without blanks: longest match over a caller's dictionary, single letters otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of Han, kana and Hangul, runs of other letters and digits, single marks.
RUNS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]+|[^\W぀-ヿ㐀-鿿豈-﫿가-힯]+|[^\w\s]")
PACKED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")


def segmenter(words: Iterable[str], keep_marks: bool = True) -> Callable[[str | None], list[str]]:
    """text -> words. A null text has none."""
    known = frozenset(w for w in words if w)
    longest = max(map(len, known), default=1)

    def cut(text: str | None) -> list[str]:
        out: list[str] = []
        for run in RUNS.findall(text or ""):
            if not PACKED.match(run):
                if keep_marks or run[0].isalnum() or run[0] == "_":
                    out.append(run)
                continue
            at = 0
            while at < len(run):
                n = min(longest, len(run) - at)
                while n > 1 and run[at : at + n] not in known:
                    n -= 1
                out.append(run[at : at + n])
                at += n
        return out

    return cut


def segment(text: Column, words: Iterable[str], keep_marks: bool = True) -> Column:
    """Words of a text column; the dictionary travels with the function, so it should be a word list, not a corpus."""
    cut = segmenter(words, keep_marks)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t if isinstance(t, str) else None))

    return run(text)
