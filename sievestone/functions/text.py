"""Text columns: tokens, stop words, n-grams, snippets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: \w and \d are ASCII in Java; classes are named.
WORD = r"[\p{L}\p{N}_]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokens(text: Column, lowercase: bool = True, keep_punct: bool = False) -> Column:
    """Words of a text, in order. A null text has none."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(t) if lowercase else t, F.lit(WORD_OR_MARK if keep_punct else WORD), 0)


def without_stop_words(words: Column, stop: Iterable[str]) -> Column:
    """Exact, case-sensitive; repeats of other words stay (array_except would drop them)."""
    listed = sorted(set(stop))
    return F.filter(words, lambda w: ~w.isin(*listed)) if listed else words


def bigrams(words: Column) -> Column:
    """Adjacent words joined without a separator; none for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, b))


def snippet(text: Column, limit: int = 33, shown: int = 30) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, shown), F.lit("......"))).otherwise(text)


def sentences(text: Column) -> Column:
    """Non-blank parts between newlines and full stops, trimmed."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n.]"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")
