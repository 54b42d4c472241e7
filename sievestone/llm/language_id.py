"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained here by stochastic gradient descent in numpy on a bounded sample of labelled rows; a temperature
calibrates the probabilities on held-out rows of that sample, and two thresholds taken from the same rows
reject texts that look like none of the languages.

Defined results: a null text, or one without letters, is `und` with score 0 and rejected. Empty tables give
empty results. Repeated rows are each judged on their own. Ties between languages go to the first by name.
Texts are read whole, in chunks, however long. Added columns replace columns of the same name. Without any
labelled row everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.llm.text import give_back, gram_streams, grams
from sievestone.session import arrow_batches

ORDERS = (2, 3, 4)
LONGEST = max(ORDERS)


@dataclass(frozen=True)
class Params:
    """sample_per_lang bounds the rows that the model is fitted on, sample_chars their texts' length."""

    sample_per_lang: int = 250
    sample_chars: int = 20_000
    max_langs: int = 256
    segment_chars: int = 300
    bits: int = 16
    dim: int = 16
    epochs: int = 4
    rate: float = 4.0
    batch: int = 64
    seed: int = 7
    rejected_share: float = 0.001
    sure: float = 0.35


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket -> logit of each language; the last column is 1 for buckets seen in training
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0
    accuracy: float = field(default=0.0)


def training_rows(docs: DataFrame, p: Params) -> DataFrame:
    """At most sample_per_lang rows of each language (text, lang), the first by a hash of the text."""
    rows = docs.select("text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= p.sample_chars)
    )
    # max_langs counts; a share of each language by the hash of the text leaves few rows to be ranked in one task
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(p.max_langs).collect()
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(2.0, 2 * p.sample_per_lang / r["n"]))])
    w = Window.partitionBy("lang").orderBy("h", "text")
    return (
        rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
        .where(F.col("h") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))
        .dropDuplicates(["lang", "text"])  # copies meet in their own task first
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= p.sample_per_lang)
        .select("text", "lang")
    )


def _features(texts: list[str], bits: int) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for stream, starts, docs in gram_streams(texts, LONGEST):
        for n in ORDERS:
            at, bucket = grams(stream, starts, n, LONGEST, bits)
            cut = np.searchsorted(at, starts)
            for k, i in enumerate(docs):
                found[i].append(bucket[cut[k] : cut[k + 1]])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def fit_rows(rows: list[tuple[str, str]], p: Params = Params()) -> Model:
    """Train on (text, lang) rows; every fifth text, by order, calibrates."""
    rows = sorted(set(rows))
    langs = sorted({lang for _, lang in rows})[: p.max_langs]
    rows = [r for r in rows if r[1] in set(langs)]
    rng = np.random.default_rng(p.seed)
    rng.shuffle(rows)
    size = 1 << p.bits
    if not langs:
        return Model([], np.zeros((size, 1), np.float32), np.zeros(0))
    code = {x: i for i, x in enumerate(langs)}
    held = rows[::5] if len(rows) >= 20 else []
    train = [r for i, r in enumerate(rows) if i % 5] if held else rows
    segments, y = [], []
    for text, lang in train:
        for a in range(0, max(len(text), 1), p.segment_chars):
            segments.append(text[a : a + p.segment_chars])
            y.append(code[lang])
    feats, y = _features(segments, p.bits), np.array(y)
    use = np.array([len(f) > 0 for f in feats], bool)
    feats, y = [f for f, u in zip(feats, use, strict=True) if u], y[use]
    emb = rng.normal(0, 0.1, (size, p.dim)).astype(np.float32)
    out, bias = np.zeros((p.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    seen = np.zeros(size, bool)
    weight = 1 / np.sqrt(np.maximum(np.bincount(y, minlength=len(langs)), 1))  # rare languages count for more
    weight /= weight[y].mean() if len(y) else 1
    steps, step = p.epochs * max(1, -(-len(feats) // p.batch)), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(feats))
        for a in range(0, len(order), p.batch):
            pick = order[a : a + p.batch]
            idx = np.concatenate([feats[i] for i in pick])
            n = np.array([len(feats[i]) for i in pick])
            cut = np.concatenate([[0], np.cumsum(n)[:-1]])
            hidden = np.add.reduceat(emb[idx], cut, axis=0) / n[:, None]
            z = hidden @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(pick)), y[pick]] -= 1
            z *= weight[y[pick]][:, None] / len(pick)
            rate = p.rate * (1 - step / steps)
            back = (z @ out.T / n[:, None]).astype(np.float32) * rate * len(pick)
            out -= rate * hidden.T @ z
            bias -= rate * z.sum(0)
            spread = np.repeat(back, n, axis=0)
            for k in range(p.dim):
                emb[:, k] -= np.bincount(idx, spread[:, k], size).astype(np.float32)
            seen[idx] = True
            step += 1
    model = Model(langs, np.concatenate([emb @ out, seen[:, None]], axis=1).astype(np.float32), bias.astype(np.float64))
    if held:
        logits, share, some = _logits([t for t, _ in held], model)
        gold = np.array([code[x] for _, x in held])[some]
        logits, share = logits[some], share[some]
        if len(gold):
            grid = np.geomspace(0.25, 4, 40)
            model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(gold)), gold] + 1e-9).mean()))
            best = _softmax(logits / model.temperature)
            model.accuracy = float((best.argmax(1) == gold).mean())
            model.least_score = float(min(p.sure, np.quantile(best.max(1), p.rejected_share)))
            model.least_seen = float(0.5 * np.quantile(share, p.rejected_share))
    return model


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Collects max_langs * sample_per_lang short rows at most; the model is 2**bits * (languages + 1) floats."""
    some = training_rows(docs, p).orderBy("lang", "text").limit(p.max_langs * p.sample_per_lang)
    return fit_rows([(r.text, r.lang) for r in some.collect()], p)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _logits(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean logits, share of subwords seen in training, whether there are letters) of each text."""
    k = len(model.langs)
    sums, counts = np.zeros((len(texts), k + 1)), np.zeros(len(texts), np.int64)
    bits = int(len(model.table) - 1).bit_length()
    for stream, starts, docs in gram_streams(texts, LONGEST):
        for n in ORDERS:
            at, bucket = grams(stream, starts, n, LONGEST, bits)
            cut = np.searchsorted(at, starts)
            total = np.zeros((len(at) + 1, k + 1))
            np.cumsum(model.table[bucket], axis=0, dtype=np.float64, out=total[1:])
            np.add.at(sums, docs, total[cut[1:]] - total[cut[:-1]])
            np.add.at(counts, docs, cut[1:] - cut[:-1])
    n = np.maximum(counts, 1)[:, None]
    return sums[:, :k] / n + model.bias, sums[:, k] / n[:, 0], counts > 0


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score from 0 to 1, rejected) of each text."""
    if not model.langs or not texts:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    logits, share, some = _logits(texts, model)
    prob = _softmax(logits / model.temperature)
    best, score = prob.argmax(1), np.where(some, prob.max(1), 0.0)
    langs = [model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
    return langs, score, ~some | (score < model.least_score) | (share < model.least_seen)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; one pass over the rows in Arrow batches, no shuffle."""
    added = ("lang_pred", "lang_score", "lang_rejected")
    kept = [c for c in docs.columns if c not in added or c == text]
    schema = T.StructType(
        [docs.schema[c] for c in kept if c not in added]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = predict(batch.column(text).to_pylist(), model)
            arrays = [batch.column(c) for c in kept if c not in added]
            names = [c for c in kept if c not in added]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], [*names, *added])
        give_back()

    arrow_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that the query's model does not learn from: crc32 of the id as text leaves 2 modulo 4. A null id: not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated thresholds don't reject."""
    columns = docs.columns
    return identify(docs, fit(docs)).where(~F.col("lang_rejected")).select(*columns)
