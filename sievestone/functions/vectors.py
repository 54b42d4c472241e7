"""Similarities of dense arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm2(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(inner_product(a, b), F.sqrt(norm2(a)) * F.sqrt(norm2(b))), F.lit(0.0))


def tanimoto(a: Column, b: Column) -> Column:
    """dot / (|a|^2 + |b|^2 - dot), 0 where that is not defined."""
    dot = inner_product(a, b)
    return F.coalesce(F.try_divide(dot, norm2(a) + norm2(b) - dot), F.lit(0.0))


MEASURES: dict[str, Callable[[Column, Column], Column]] = {"dot": inner_product, "cos": cosine, "jac": tanimoto}
