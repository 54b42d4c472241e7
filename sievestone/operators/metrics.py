"""Evaluation: accuracy, overlap of letters, exact match, BLEU-1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row; null for no rows. A null never equals anything."""
    return rows.agg(F.avg(F.coalesce(F.col(predicted) == F.col(gold), F.lit(False)).cast("int")).alias("accuracy"))


def letters(c: Column, strip_space: bool = False) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.split(F.regexp_replace(t, r"\s", "") if strip_space else t, "")


def letter_overlap(rows: DataFrame, keys: Sequence[str], predicted: str, gold: str, strip_space: bool = False) -> DataFrame:
    """keys, same, n_pred, n_gold: letters in common with repeats (multiset intersection). Keys must be unique."""
    long = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), letters(F.col(predicted), strip_space).alias("cs")), F.struct(F.lit(1).alias("side"), letters(F.col(gold), strip_space).alias("cs")))).alias("s"))
    each = long.select(*keys, "s.side", F.explode("s.cs").alias("c")).where("c <> ''")
    counts = each.groupBy(*keys, "c").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("g"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("p", "g")).alias("same"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"))
    zero = F.lit(0).cast("bigint")
    return rows.select(*keys).join(sums, list(keys), "left").select(*keys, *[F.coalesce(c, zero).alias(c) for c in ("same", "n_pred", "n_gold")])


def precision_recall_f1(overlap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, precision, recall, f1; all 0 where nothing is shared."""
    p = F.coalesce(F.try_divide("same", "n_pred"), F.lit(0.0))
    r = F.coalesce(F.try_divide("same", "n_gold"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return overlap.select(*keys, p.alias("p"), r.alias("r")).select(*keys, F.col("p").alias("precision"), F.col("r").alias("recall"), f.alias("f1"))


def bleu1(overlap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bleu1: clipped unigram precision times the brevity penalty. overlap: of letters without white space."""
    short = F.when(F.col("n_pred") > F.col("n_gold"), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide("n_gold", "n_pred")))
    return overlap.select(*keys, F.coalesce(F.try_divide("same", "n_pred") * short, F.lit(0.0)).alias("bleu1"))


def exact_match(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    return accuracy(rows, predicted, gold).withColumnRenamed("accuracy", "exact_match")
