"""Quality rules: base counts of a text, and a hashed word and character n-gram logistic regression.

The regression is trained here in numpy on a bounded sample of labelled rows, its probabilities are calibrated on
held-out rows of that sample (Platt), and documents are scored in Arrow batches against a fixed threshold.

A word is a maximal run of anything but space, tab, newline, vertical tab, form feed and carriage return. Words in
repeated five-word windows are found by 64-bit hashes of the windows.

Defined results: a null text counts as empty: all counts 0, base_failed. Texts are read whole, in chunks of whole
texts; a single text is one chunk. Repeated rows are each scored. Without rows of both classes there is no model and
a text that passes the base rules is kept. Labels that disagree about a document: the greater counts. Columns that
the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.llm.text import CHUNK, code_points, mix
from sievestone.session import arrow_batches

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = np.zeros(0x110000, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(0x110000, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Params:
    """sample_per_class bounds the labelled rows that the model is fitted on, sample_chars their length."""

    sample_per_class: int = 1500
    sample_chars: int = 20_000
    bits: int = 17
    char_orders: tuple[int, ...] = (2, 3)
    epochs: int = 6
    rate: float = 1.0
    l2: float = 1e-5
    batch: int = 32
    seed: int = 11
    threshold: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20


@dataclass
class Model:
    weights: np.ndarray  # one table for words and every order of character n-grams
    bias: float
    slope: float = 1.0
    shift: float = 0.0


class Chunk:
    """Some texts as one stream of code points with a space after each."""

    def __init__(self, texts: list[str]):
        flat = code_points(" ".join([*texts, ""]))
        self.flat, self.n = flat, len(texts)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        space = SPACE[flat]
        inside = ~space
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.word_cut = np.searchsorted(self.starts, self.bounds)
        self.space = space
        # the hash of a word: its code points' own hashes times powers of an odd number, brought to the word's start
        power = _powers(len(flat))
        value = mix((flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[0][: len(flat)])])
        self.words = mix((total[self.ends] - total[self.starts]) * power[1][self.starts] + (self.ends - self.starts).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def counts(self) -> dict[str, np.ndarray]:
        n_words = np.diff(self.word_cut)
        lengths = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        return {
            "n_words": n_words,
            "word_chars": lengths[self.word_cut[1:]] - lengths[self.word_cut[:-1]],
            "n_symbols": self.per_text(SYMBOL[self.flat]),
            "n_repeat_words": self.repeated(),
        }

    def repeated(self) -> np.ndarray:
        """Words inside five-word windows that a text holds twice or more."""
        w, m = self.words, len(self.words)
        covered = np.zeros(m + WINDOW + 1, np.int64)
        if m >= WINDOW:
            doc = np.repeat(np.arange(self.n), np.diff(self.word_cut)).astype(np.uint64)
            size = m - WINDOW + 1
            h = doc[:size] * np.uint64(0x9FB21C651E98DF25)
            for k in range(WINDOW):
                h = mix(h * np.uint64(0xA24BAED4963EE407) + w[k : k + size])
            own = np.flatnonzero(doc[:size] == doc[WINDOW - 1 :])
            h = h[own]
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = own[twice]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:m] > 0)])
        return inside[self.word_cut[1:]] - inside[self.word_cut[:-1]]

    def features(self, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets, cut) for words and each order of character n-grams; cut: where each text's begin."""
        shift = np.uint64(64 - p.bits)
        yield (self.words >> shift).astype(np.int64), self.word_cut
        for n in p.char_orders:
            size = max(0, len(self.flat) - n + 1)
            good = ~(self.space[:size] & self.space[n - 1 : n - 1 + size])
            for k in range(1, n - 1):
                good &= ~self.space[k : k + size]
            for k in range(1, n):  # not from one text into the next
                ends = self.bounds[1:] - k
                good[ends[ends < size]] = False
            at = np.flatnonzero(good)
            h = np.full(len(at), n * 77, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + self.flat[at + k]
            yield (mix(h) >> shift).astype(np.int64), np.searchsorted(at, self.bounds)


_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _power or len(_power[0]) < n:
        size = max(n, 2 * CHUNK)
        base = 0x5851F42D4C957F2D
        _power[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64))]
    return _power[0], _power[1]


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """Whole texts, some hundred thousand code points at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _margins(chunk: Chunk, model: Model, p: Params) -> np.ndarray:
    """Each family of features counts by its mean."""
    z = np.full(chunk.n, model.bias)
    for bucket, cut in chunk.features(p):
        total = np.concatenate([[0.0], np.cumsum(model.weights[bucket], dtype=np.float64)])
        z += (total[cut[1:]] - total[cut[:-1]]) / np.maximum(cut[1:] - cut[:-1], 1)
    return z


def fit_rows(rows: list[tuple[str, int]], p: Params = Params(), totals: dict[int, int] | None = None) -> Model | None:
    """Train on (text, label) rows; every fifth calibrates. Adaptive steps for each weight.

    totals: labelled rows of each class in all, if the sample's shares differ from theirs; probabilities follow these.
    """
    rows = sorted(set(rows))
    rng = np.random.default_rng(p.seed)
    rng.shuffle(rows)
    if len({y for _, y in rows}) < 2:
        return None
    held = rows[::5] if len(rows) >= 50 else rows
    train = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    index, value, cut = [], [], [0]
    for text, _ in train:
        for bucket, _cut in Chunk([text]).features(p):
            b, n = np.unique(bucket, return_counts=True)
            index.append(b)
            value.append(n / max(n.sum(), 1))
        cut.append(cut[-1] + sum(len(x) for x in index[-1 - len(p.char_orders) :]))
    index, value, cut = np.concatenate(index), np.concatenate(value).astype(np.float32), np.array(cut)
    y = np.array([y for _, y in train], np.float64)
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, grown, bias = np.zeros(1 << p.bits), np.full(1 << p.bits, 1e-8), 0.0
    for _ in range(p.epochs):
        for pick in np.array_split(rng.permutation(len(train)), max(1, len(train) // p.batch)):
            spans = [np.arange(cut[i], cut[i + 1]) for i in pick]
            at, n = np.concatenate(spans), np.array([len(s) for s in spans])
            i, x = index[at], value[at]
            row = np.repeat(np.arange(len(pick)), n)
            z = np.bincount(row, w[i] * x, len(pick)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            used, back = np.unique(i, return_inverse=True)
            step = np.bincount(back, g[row] * x, len(used)) + p.l2 * w[used]
            grown[used] += step * step
            w[used] -= p.rate * step / np.sqrt(grown[used])
            bias -= 0.1 * g.sum()
    model = Model(w.astype(np.float32), bias)
    z = np.concatenate([_margins(Chunk([t]), model, p) for t, _ in held])
    gold = np.array([y for _, y in held], np.float64)
    # Platt: targets drawn in from 0 and 1, Newton's method
    pos, neg = gold.sum(), len(gold) - gold.sum()
    target = np.where(gold == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, count = np.array([1.0, 0.0]), np.ones(len(gold))
    if totals and pos and neg:
        share = totals[1] / (totals[0] + totals[1])
        count = np.where(gold == 1, share * len(gold) / pos, (1 - share) * len(gold) / neg)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a[0] * z + a[1], -30, 30)))
        grad = np.array([(count * (s - target) * z).sum(), (count * (s - target)).sum()])
        v = count * s * (1 - s) + 1e-9
        hess = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        a -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    model.slope, model.shift = float(a[0]), float(a[1])
    return model


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), each document once."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))


def class_counts(labels: DataFrame) -> dict[int, int]:
    """Two counts at most."""
    return {r["quality"]: r["n"] for r in labelled(labels).groupBy("quality").agg(F.count("*").alias("n")).collect()}


def training_rows(docs: DataFrame, labels: DataFrame, counts: dict[int, int], p: Params = Params()) -> DataFrame:
    """(text, quality) of at most sample_per_class labelled documents of each class, by a hash of the id."""
    once = labelled(labels)
    # a share of each class by the hash of the id leaves few rows to be ranked in one task
    share = F.when(F.col("quality") == 1, F.lit(2 * p.sample_per_class / counts.get(1, 1))).otherwise(F.lit(2 * p.sample_per_class / counts.get(0, 1)))
    w = Window.partitionBy("quality").orderBy("h", "doc_id")
    picked = (
        once.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
        .where(F.col("h") < share * (1 << 30))
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= p.sample_per_class)
        .select("doc_id", "quality")
    )
    # two times sample_per_class rows of two numbers at most
    return (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= p.sample_chars))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
        .select("text", "quality")
    )


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    counts = class_counts(labels)
    return fit_rows([(r.text, r.quality) for r in training_rows(docs, labels, counts, p).collect()], p, counts)


def measure(texts: list[str | None], model: Model | None, p: Params = Params()) -> dict[str, np.ndarray]:
    """The counts, the calibrated probability and both verdicts of each text."""
    out: dict[str, list[np.ndarray]] = {}
    for some in chunks(texts):
        chunk = Chunk(some)
        got = chunk.counts()
        got["n_dup_lines"] = np.array([dup_lines(t) for t in some], np.int64)
        z = _margins(chunk, model, p) if model else np.full(chunk.n, 30.0)
        got["quality_prob"] = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30))) if model else np.ones(chunk.n)
        for k, v in got.items():
            out.setdefault(k, []).append(v)
    if not out:
        out = {k: [np.zeros(0, np.int64)] for k in COUNTS} | {"quality_prob": [np.zeros(0)]}
    found = {k: np.concatenate(v) for k, v in out.items()}
    found["base_failed"] = (found["n_words"] < p.min_words) | (100 * found["n_repeat_words"] > p.max_repeat_percent * found["n_words"])
    found["kept"] = ~found["base_failed"] & (found["quality_prob"] >= p.threshold)
    return found


def score(docs: DataFrame, model: Model | None, p: Params = Params(), text: str = "text") -> DataFrame:
    """docs with the counts, quality_prob, base_failed and kept; one pass in Arrow batches, no shuffle."""
    added = {**dict.fromkeys(COUNTS, T.LongType()), "quality_prob": T.DoubleType(), "base_failed": T.BooleanType(), "kept": T.BooleanType()}
    rest = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(k, v) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure(batch.column(text).to_pylist(), model, p)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(got[k]) for k in added)], [*rest, *added])

    arrow_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*rest, text])]).mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", *COUNTS, "base_failed", "kept", "quality_prob")
